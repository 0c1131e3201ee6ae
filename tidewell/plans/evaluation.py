"""Evaluation statistics, scalar functions and text retrieval."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import scalars as X
from tidewell.operators import metrics as M
from tidewell.operators import retrieval as R
from tidewell.operators import splits as P
from tidewell.plans.registry import query, read
from tidewell.sources.flows import FLOWS_SQL, flows

_PRED = f"(select flow_id, label as truth, case when packets % 3 = 0 then 'click' when packets % 3 = 1 then label else 'other' end as predicted, bytes as score, src as grp from {FLOWS_SQL} f)"


def _pred(spark, sf_dir):
    m = F.col("packets") % 3
    return flows(spark, sf_dir).select("flow_id", F.col("label").alias("truth"), F.when(m == 0, "click").when(m == 1, F.col("label")).otherwise("other").alias("predicted"), F.col("bytes").alias("score"), F.col("src").alias("grp"))


@query("evl_e1_confusion", f"select truth, predicted, count(*) as n from {_PRED} p group by all")
def e1(spark, sf_dir):
    return M.confusion(_pred(spark, sf_dir), "truth", "predicted")


@query("evl_e1_per_class", f"""with c as (select distinct truth as label from {_PRED} p), k as (select label, count(*) filter (truth = label and predicted = label) tp, count(*) filter (truth <> label and predicted = label) fp, count(*) filter (truth = label and predicted <> label) fn from c, {_PRED} p group by 1)
select label, tp, fp, fn, case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision, tp / (tp + fn) as recall, case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1 from k""")
def e1_class(spark, sf_dir):
    return M.per_class(M.confusion(_pred(spark, sf_dir), "truth", "predicted"))


@query("evl_e2_binary", f"select count(*) filter (truth = 'error' and predicted = 'error') as tp, count(*) filter (truth <> 'error' and predicted = 'error') as fp, count(*) filter (truth = 'error' and predicted <> 'error') as fn, count(*) filter (truth <> 'error' and predicted <> 'error') as tn from {_PRED} p")
def e2(spark, sf_dir):
    t, p = F.col("truth") == "error", F.col("predicted") == "error"
    return _pred(spark, sf_dir).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


@query("evl_e3_recoverability", f"select truth, count(*) as n, count(*) filter (predicted <> truth and score > 2000) as recoverable, count(*) filter (predicted = truth and score < 500) as harmed from {_PRED} p group by 1")
def e3(spark, sf_dir):
    right = F.col("truth") == F.col("predicted")
    return _pred(spark, sf_dir).groupBy("truth").agg(F.count("*").alias("n"), F.count_if(~right & (F.col("score") > 2000)).alias("recoverable"), F.count_if(right & (F.col("score") < 500)).alias("harmed"))


@query("evl_e4_transitions", f"select predicted = truth as before_ok, score % 2 = 0 as after_ok, count(*) as n from {_PRED} p group by all")
def e4(spark, sf_dir):
    return _pred(spark, sf_dir).groupBy((F.col("predicted") == F.col("truth")).alias("before_ok"), (F.col("score") % 2 == 0).alias("after_ok")).agg(F.count("*").alias("n"))


@query("evl_e5_score_stats", f"select truth, count(*) as n, cast(sum(score) as bigint) as total, quantile_cont(score, 0.5) as median, quantile_cont(score, 0.75) as p75, quantile_cont(score, 0.9) as p90 from {_PRED} p group by 1")
def e5(spark, sf_dir):
    p = _pred(spark, sf_dir)
    total = p.groupBy("truth").agg(F.sum("score").alias("total"))
    return P.quantiles(p, "score", {"median": 0.5, "p75": 0.75, "p90": 0.9}, ["truth"]).join(total, "truth").select("truth", "n", "total", "median", "p75", "p90")


@query("evl_e6_auroc", f"with b as (select score s, count(*) filter (truth = 'error') p, count(*) filter (truth <> 'error') q from {_PRED} x group by 1), r as (select *, coalesce(sum(q) over (order by s rows between unbounded preceding and 1 preceding), 0) below from b) select cast(sum(p) as bigint) as positives, cast(sum(q) as bigint) as negatives, cast(sum(p * (2 * below + q)) as bigint) as wins2 from r")
def e6(spark, sf_dir):
    return M.auroc_counts(_pred(spark, sf_dir).withColumn("pos", F.col("truth") == "error"), "score", "pos")


@query("evl_e7_threshold", f"with t as (select quantile_cont(score, 0.95) as cut from {_PRED} p where truth <> 'error') select cut, count(*) filter (truth = 'error' and score >= cut) as caught, count(*) filter (truth <> 'error' and score >= cut) as wrong from {_PRED} p, t group by cut")
def e7(spark, sf_dir):
    p = _pred(spark, sf_dir)
    cut = P.quantiles(p.where("truth <> 'error'"), "score", {"cut": 0.95}).select("cut")  # one row
    return p.crossJoin(F.broadcast(cut)).groupBy("cut").agg(F.count_if((F.col("truth") == "error") & (F.col("score") >= F.col("cut"))).alias("caught"), F.count_if((F.col("truth") != "error") & (F.col("score") >= F.col("cut"))).alias("wrong"))


@query("evl_e8_calibration_bins", f"select cast(least(9, score // 5000) as bigint) as bin, count(*) as n, count(*) filter (truth = predicted) as correct, cast(sum(score) as bigint) as total from {_PRED} p group by 1")
def e8(spark, sf_dir):
    return _pred(spark, sf_dir).groupBy(F.least(F.lit(9), F.floor(F.col("score") / 5000)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("correct"), F.sum("score").alias("total"))


@query("evl_e9_bootstrap", f"""with g as (select grp, count(*) n, count(*) filter (truth = predicted) k from {_PRED} p group by 1), r as (select unnest(range(200)) as rep), w as (select rep, n, k, cast(cast('0x' || substr(sha256(rep || '|' || grp), 1, 15) as bigint) % 3 as bigint) as wt from g, r)
select cast(rep as bigint) as rep, cast(sum(wt * n) as bigint) as n, cast(sum(wt * k) as bigint) as correct from w group by rep""")
def e9(spark, sf_dir):
    """Groups are counted first; each replicate weighs a group's counts by a hash of both, so replicates need no draw order."""
    g = _pred(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("k"))
    w = g.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))))
    weight = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", "rep", "grp"), 256), 1, 15), 16, 10).cast("long"), F.lit(3))
    return w.groupBy("rep").agg(F.sum(weight * F.col("n")).alias("n"), F.sum(weight * F.col("k")).alias("correct"))


@query("evl_e10_wilson", f"""with c as (select truth, count(*) n, count(*) filter (truth = predicted) k from {_PRED} p group by 1), d as (select *, k / n as p, 1.959963984540054::double as z from c)
select truth, n, k, round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) as low, round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) as high from d""")
def e10(spark, sf_dir):
    c = _pred(spark, sf_dir).groupBy("truth").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return c.select("truth", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("evl_e11_rotation_means", f"with r as (select grp % 3 as rotation, truth, count(*) n, count(*) filter (truth = predicted) k from {_PRED} p group by all) select truth, cast(sum(k) as bigint) as pooled_k, cast(sum(n) as bigint) as pooled_n, count(*) as rotations from r group by 1")
def e11(spark, sf_dir):
    r = _pred(spark, sf_dir).groupBy((F.col("grp") % 3).alias("rotation"), "truth").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("k"))
    return r.groupBy("truth").agg(F.sum("k").alias("pooled_k"), F.sum("n").alias("pooled_n"), F.count("*").alias("rotations"))


@query("evl_e12_class_means", "with e as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as dim from embeddings) select label, cast(dim - 1 as bigint) as dim, count(*) as n, round(avg(v::double), 6) as mean from e group by all")
def e12(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("fun_f1_safe_parse", "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) as k, coalesce(try_cast(event_type as bigint), 0) as bad from events")
def f1(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", X.safe_long(F.get_json_object("props", "$.k"), -1).alias("k"), X.safe_long(F.col("event_type"), 0).alias("bad"))


@query("fun_f3_protocol", f"select flow_id, case dport when 0 then 1 when 1 then 6 when 2 then 17 end as protocol from {FLOWS_SQL} f")
def f3(spark, sf_dir):
    name = F.element_at(F.array(F.lit("ICMP"), F.lit("tcp"), F.lit("Udp")), F.when(F.col("dport") < 3, F.col("dport") + 1).otherwise(1))
    return flows(spark, sf_dir).select("flow_id", X.protocol_number(F.when(F.col("dport") < 3, name)).alias("protocol"))


@query("fun_f4_service", f"select flow_id, case when least(src, dst) in (22, 53, 80) then 'known' when least(src, dst) < 1024 then 'system' else 'dynamic' end as service from {FLOWS_SQL} f")
def f4(spark, sf_dir):
    low = F.least("src", "dst")
    return flows(spark, sf_dir).select("flow_id", F.when(low.isin(22, 53, 80), "known").when(low < 1024, "system").otherwise("dynamic").alias("service"))


@query("fun_f5_day_range", f"select flow_id, cast(unnest(range(start_ms // 86400000, (end_ms + 43200000) // 86400000 + 1)) as bigint) as day from {FLOWS_SQL} f")
def f5(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", F.explode(F.sequence(F.floor(F.col("start_ms") / 86_400_000), F.floor((F.col("end_ms") + 43_200_000) / 86_400_000))).alias("day"))


@query("fun_f8_sanitize", "select doc_id, length(regexp_replace(regexp_replace(text, '[0-9]{1,3}(\\.[0-9]{1,3}){3}', '<IP>', 'g'), '[0-9]{6,}', '<NUM>', 'g')) as n, length(regexp_replace(regexp_replace(text, '[0-9]{1,3}(\\.[0-9]{1,3}){3}', '<IP>', 'g'), '[0-9]{6,}', '<NUM>', 'g')) <> length(text) as changed from documents")
def f8(spark, sf_dir):
    s = X.sanitize(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(s).cast("long").alias("n"), (F.length(s) != F.length("text")).alias("changed"))


@query("fun_f11_signals", f"select flow_id, array_to_string(list_filter([case when bytes > 5000 then 'bulk' end, case when packets >= 8 then 'long' end, case when label = 'error' then 'failed' end], lambda x: x is not null), ',') as signals from {FLOWS_SQL} f")
def f11(spark, sf_dir):
    s = F.array_compact(F.array(F.when(F.col("bytes") > 5000, "bulk"), F.when(F.col("packets") >= 8, "long"), F.when(F.col("label") == "error", "failed")))
    return flows(spark, sf_dir).select("flow_id", F.array_join(s, ",").alias("signals"))


@query("fun_f13_buckets", f"select flow_id, case when packets <= 1 then 'one' when packets <= 4 then 'few' when packets <= 8 then 'some' else 'many' end as bucket from {FLOWS_SQL} f")
def f13(spark, sf_dir):
    p = F.col("packets")
    return flows(spark, sf_dir).select("flow_id", F.when(p <= 1, "one").when(p <= 4, "few").when(p <= 8, "some").otherwise("many").alias("bucket"))


@query("fun_f14_log_scale", f"select flow_id, round(sign(bytes - 1000) * ln(1 + abs(bytes - 1000)), 6) as x from {FLOWS_SQL} f")
def f14(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", F.round(X.signed_log(F.col("bytes") - 1000), 6).alias("x"))


@query("fun_f15_entropy", f"with c as (select src, label, count(*) n from {FLOWS_SQL} f group by all), t as (select *, n / sum(n) over (partition by src) p from c) select src, round(-sum(p * ln(p)), 9) as entropy, max(n) as top from t group by 1")
def f15(spark, sf_dir):
    c = flows(spark, sf_dir).groupBy("src", "label").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("src"))
    return c.withColumn("p", p).groupBy("src").agg(F.round(-F.sum(F.col("p") * F.log("p")), 9).alias("entropy"), F.max("n").alias("top"))


@query("fun_f18_log2_signature", f"select flow_id, cast(floor(log2(greatest(1, bytes))) as bigint) as b, cast(floor(log2(greatest(1, packets))) as bigint) as p from {FLOWS_SQL} f")
def f18(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", X.log2_bucket("bytes").alias("b"), X.log2_bucket("packets").alias("p"))


@query("fun_f21_ip_number", f"select flow_id, cast(10 * 16777216 + (src % 256) * 65536 + (dst % 256) * 256 + dport as bigint) as ip from {FLOWS_SQL} f")
def f21(spark, sf_dir):
    ip = F.concat_ws(".", F.lit("10"), F.col("src") % 256, F.col("dst") % 256, F.col("dport"))
    return flows(spark, sf_dir).select("flow_id", X.ip_number(ip).alias("ip"))


@query("txt_r3_word_chunks", "with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents), c as (select doc_id, unnest(range(0, greatest(len(w), 1), 128)) as start, w from w) select doc_id, cast(start as bigint) as start, cast(len(w[start + 1:start + 160]) as bigint) as n_words from c where len(w[start + 1:start + 160]) > 0")
def r3(spark, sf_dir):
    return R.word_chunks(read(spark, sf_dir, "documents"), "doc_id", "text", 160, 32).select("doc_id", "start", F.size("words").cast("long").alias("n_words"))


@query("txt_r5_tokens", "with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{1,40}')) as term from documents) select doc_id, count(*) as n, count(distinct term) as terms from t group by 1")
def r5(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", R.tokens("text").alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("terms"))


_BM25 = """with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{1,40}')) as term from documents), p as (select doc_id, term, count(*) tf from t group by all), l as (select doc_id, sum(tf) len from p group by 1), s as (select count(*) n, avg(len) a from (select d.doc_id, coalesce(len, 0) len from documents d left join l using (doc_id))),
q as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{1,40}')) as term from benchmark), qt as (select item_id, term, count(*) qf from q group by all), df as (select term, count(*) df from p group by 1),
sc as (select item_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len / a))), 6) as score from qt join p using (term) join df using (term) join l using (doc_id), s group by all)
select item_id, doc_id, score from sc qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10"""


@query("txt_r6_bm25", _BM25)
def r6(spark, sf_dir):
    d, q = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    scored = R.bm25(d, "doc_id", "text", q, "item_id", "text").withColumn("score", F.round("score", 6))
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).where("r <= 10").select("item_id", "doc_id", "score")


@query("txt_r8_query_guard", "select item_id, length(text) between 1 and 2000 and not regexp_matches(text, '[0-9]{1,3}(\\.[0-9]{1,3}){3}') as safe from benchmark")
def r8(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", (F.length("text").between(1, 2000) & ~F.col("text").rlike(X.IPV4)).alias("safe"))
