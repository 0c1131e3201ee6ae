"""Queries of the evaluation statistics in full: totals, ranks, calibration, intervals, geometry, gates and what is built of them."""

from pyspark.sql import functions as F

from tidewell.operators import metrics as M
from tidewell.operators import splits as P
from tidewell.plans.registry import query, read
from tidewell.sources.flows import FLOWS_SQL, flows

#: Predictions without evidence, with either kind and with both; what was acquired; whether a row was rejected before and after.
_COLS = [
    "flow_id", "label as truth", "case when packets % 3 = 0 then 'click' when packets % 3 = 1 then label else 'other' end as b",
    "case when flow_id % 3 = 0 then label else 'view' end as bt", "case when flow_id % 4 = 0 then label else 'click' end as br", "case when flow_id % 5 < 2 then label else 'error' end as btr",
    "case flow_id % 4 when 0 then 'NONE' when 1 then 'T' when 2 then 'R' else 'TR' end as action", "bytes as score", "bytes % 5 = 0 as rejected_pre", "bytes % 7 = 0 as rejected_post",
    "src % 3 as rotation", "src % 40 as grp", "packets as conf16",
]
_P = f"(select {', '.join(_COLS)} from {FLOWS_SQL} z)"


def _p(spark, sf_dir):
    return flows(spark, sf_dir).selectExpr(*_COLS)


_MACRO = """with c as (select distinct truth as label from {p} p), k as (select label, count(*) filter (truth = label and b = label) tp, count(*) filter (truth <> label and b = label) fp, count(*) filter (truth = label and b <> label) fn from c, {p} p group by 1),
m as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as pr, tp / (tp + fn) as re, case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1 from k),
t as (select sum(tp) / sum(tp + fp) as mp, sum(tp) / sum(tp + fn) as mr, avg(pr) as ap, avg(re) as ar, avg(f1) as af from m)
select (select count(*) from {p} p) as n, (select count(*) from {p} p where b not in (select label from c)) as invalid, round((select count(*) filter (b = truth) / count(*) from {p} p), 9) as accuracy, round(ap, 9) as macro_precision, round(ar, 9) as macro_recall, round(af, 9) as macro_f1,
 round(mp, 9) as micro_precision, round(mr, 9) as micro_recall, round(2 * mp * mr / (mp + mr), 9) as micro_f1 from t""".format(p=_P)


@query("evl_e1_totals", _MACRO)
def e1(spark, sf_dir):
    counts = M.confusion(_p(spark, sf_dir), "truth", "b")
    t = M.totals(M.per_class(counts), counts)
    return t.select("n", "invalid", *[F.round(c, 9).alias(c) for c in t.columns[2:]])


_SETS = "list_filter(['a', case when dport % 2 = 0 then 'b' end, case when dport % 3 = 0 then 'c' end], lambda x: x is not null) as t, list_filter([case when packets % 2 = 0 then 'a' end, 'b', case when packets % 5 = 0 then 'c' end], lambda x: x is not null) as p"


@query("evl_e2_multilabel", f"""with s as (select flow_id, {_SETS} from {FLOWS_SQL} f), f as (select unnest(['a', 'b', 'c']) as family)
select family, count(*) filter (list_contains(t, family) and list_contains(p, family)) as tp, count(*) filter (not list_contains(t, family) and list_contains(p, family)) as fp, count(*) filter (list_contains(t, family) and not list_contains(p, family)) as fn from f, s group by 1
union all select '', count(*) filter (list_sort(t) = list_sort(p)), count(*) filter (list_sort(t) <> list_sort(p)), 0 from s""")
def e2(spark, sf_dir):
    sets = lambda *c: F.array_compact(F.array(*[F.when(F.expr(w), v) for w, v in c]))
    f = flows(spark, sf_dir).select(sets(("true", "a"), ("dport % 2 = 0", "b"), ("dport % 3 = 0", "c")).alias("t"), sets(("packets % 2 = 0", "a"), ("true", "b"), ("packets % 5 = 0", "c")).alias("p"))
    return M.multilabel(f, "t", "p")


def _flags() -> dict[str, str]:
    wrong = "b <> truth"
    return {
        "n": "true", "help": f"{wrong} and bt = truth", "harm": "b = truth and bt <> truth", "recoverable": f"{wrong} and (bt = truth or br = truth or btr = truth)", "residual": f"{wrong} and bt <> truth and br <> truth and btr <> truth",
        "unique_t": f"{wrong} and bt = truth and br <> truth", "unique_r": f"{wrong} and br = truth and bt <> truth", "shared": f"{wrong} and bt = truth and br = truth", "full_only": f"{wrong} and bt <> truth and br <> truth and btr = truth",
    }


@query("evl_e3_diversity", f"select truth, {', '.join(f'count(*) filter ({w}) as {n}' for n, w in _flags().items())} from {_P} p group by 1")
def e3(spark, sf_dir):
    return _p(spark, sf_dir).groupBy("truth").agg(*[F.count_if(F.expr(w)).alias(n) for n, w in _flags().items()])


_SELECTED = "case action when 'T' then bt when 'R' then br when 'TR' then btr else b end"


@query("evl_e3_selective", f"""with s as (select *, {_SELECTED} as final from {_P} p) select count(*) filter (action <> 'NONE') as selected, count(*) filter (action <> 'NONE' and b <> truth and final = truth) as help, count(*) filter (action <> 'NONE' and b = truth and final <> truth) as harm,
 count(*) filter (final = truth) as correct, count(*) as n from s""")
def e3_selective(spark, sf_dir):
    s = _p(spark, sf_dir).withColumn("final", F.expr(_SELECTED))
    cells = {"selected": "action <> 'NONE'", "help": "action <> 'NONE' and b <> truth and final = truth", "harm": "action <> 'NONE' and b = truth and final <> truth", "correct": "final = truth", "n": "true"}
    return s.agg(*[F.count_if(F.expr(w)).alias(n) for n, w in cells.items()])


_E4 = {"furk": "rejected_post", "accepted": "final = truth and not rejected_post", "recovered_rejected": "final = truth and rejected_post", "stay_known": "not rejected_pre and not rejected_post", "to_known": "rejected_pre and not rejected_post", "to_unknown": "not rejected_pre and rejected_post", "stay_unknown": "rejected_pre and rejected_post"}


@query("evl_e4_transition_table", f"""with s as (select *, {_SELECTED} as final from {_P} p where {_flags()['recoverable']}) select action, truth, count(*) as n, {', '.join(f'count(*) filter ({w}) as {n}' for n, w in _E4.items())} from s group by 1, 2""")
def e4(spark, sf_dir):
    """Recoverable rows by action and class: what is rejected after all, what is recovered and kept, and how decisions move."""
    s = _p(spark, sf_dir).withColumn("final", F.expr(_SELECTED)).where(_flags()["recoverable"])
    return s.groupBy("action", "truth").agg(F.count("*").alias("n"), *[F.count_if(F.expr(w)).alias(n) for n, w in _E4.items()])


@query("evl_e5_shift", f"select truth, count(*) as n, quantile_cont(d, 0.5) as median, quantile_cont(d, 0.75) as p75, quantile_cont(d, 0.9) as p90, quantile_cont(d, 0.95) as p95 from (select truth, score - conf16 * 100 as d from {_P} p) group by 1")
def e5(spark, sf_dir):
    d = _p(spark, sf_dir).select("truth", (F.col("score") - F.col("conf16") * 100).alias("d"))
    return P.quantiles(d, "d", {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}, ["truth"])


@query("evl_e6_average_precision", f"""with g as (select score, count(*) filter (truth = 'error') p, count(*) n from {_P} x group by 1), r as (select *, sum(p) over w as tp, sum(n) over w as k from g window w as (order by score desc rows unbounded preceding)) select round(sum(p * (tp / k)) / sum(p), 9) as ap from r""")
def e6(spark, sf_dir):
    return M.average_precision(_p(spark, sf_dir).withColumn("pos", F.col("truth") == "error"), "score", "pos").select(F.round("ap", 9).alias("ap"))


@query("evl_e6_weighted", f"""with b as (select score s, sum(conf16) filter (truth = 'error') p, sum(conf16) filter (truth <> 'error') q from {_P} x group by 1), c as (select s, coalesce(p, 0) p, coalesce(q, 0) q from b), r as (select *, coalesce(sum(q) over (order by s rows between unbounded preceding and 1 preceding), 0) below from c)
select cast(sum(p) as bigint) as positives, cast(sum(q) as bigint) as negatives, cast(sum(p * (2 * below + q)) as bigint) as wins2 from r""")
def e6_weighted(spark, sf_dir):
    return M.auroc_counts(_p(spark, sf_dir).withColumn("pos", F.col("truth") == "error"), "score", "pos", "conf16")


@query("evl_e6_spearman", f"""with p as (select score as x, grp as y, conf16 as w from {_P} z), u as (select x, sum(w) as w from p group by 1), v as (select y, sum(w) as w from p group by 1), rx as (select x, coalesce(sum(w) over (order by x rows between unbounded preceding and 1 preceding), 0) + (w + 1) / 2 as r from u),
ry as (select y, coalesce(sum(w) over (order by y rows between unbounded preceding and 1 preceding), 0) + (w + 1) / 2 as r from v), j as (select rx.r as a, ry.r as b, w::double as w from p join rx using (x) join ry using (y)),
s as (select sum(w) n, sum(w*a) a, sum(w*b) b, sum(w*a*a) aa, sum(w*b*b) bb, sum(w*a*b) ab from j) select round((ab - a*b/n) / sqrt((aa - a*a/n) * (bb - b*b/n)), 6) as rho from s""")
def e6_spearman(spark, sf_dir):
    p = _p(spark, sf_dir).select(F.col("score").alias("x"), F.col("grp").alias("y"), F.col("conf16").alias("w"))
    ranked = M.weighted_ranks(M.weighted_ranks(p, "x", "w", "rx"), "y", "w", "ry")
    return ranked.agg(F.round(M.weighted_pearson("rx", "ry", "w"), 6).alias("rho"))


@query("evl_e7_fpr_at_tpr", f"""with g as (select score s, count(*) filter (truth = 'error') p, count(*) filter (truth <> 'error') q from {_P} x group by 1), r as (select *, sum(p) over w as tp, sum(q) over w as fp, sum(p) over () as ap, sum(q) over () as aq from g window w as (order by s desc rows unbounded preceding))
select round(fp / aq, 9) as fpr from r where tp / ap >= 0.95::double order by s desc limit 1""")
def e7(spark, sf_dir):
    return M.fpr_at_tpr(_p(spark, sf_dir).withColumn("pos", F.col("truth") == "error"), "score", "pos", 0.95).select(F.round("fpr", 9).alias("fpr"))


_CONF = "(conf16 - 0.5::double) / 16"


@query("evl_e8_calibration", f"""with c as (select {_CONF} as c, b = truth as ok from {_P} p), b as (select cast(least(9, floor(c * 10)) as bigint) as bin, count(*) as n, count(*) filter (ok) as k, sum(c) as s from c group by 1) select round(sum(abs(k - s)) / sum(n), 9) as ece, round(sum(s) / sum(n), 9) as mean_confidence, sum(n)::bigint as n from b""")
def e8(spark, sf_dir):
    c = _p(spark, sf_dir).select(((F.col("conf16") - 0.5) / 16).alias("c"), (F.col("b") == F.col("truth")).alias("ok"))
    b = M.calibration(c, "c", "ok")
    return b.agg(F.round(F.sum(F.abs(F.col("correct") - F.col("confidence"))) / F.sum("n"), 9).alias("ece"), F.round(F.sum("confidence") / F.sum("n"), 9).alias("mean_confidence"), F.sum("n").alias("n"))


@query("evl_e8_losses", f"""with c as (select {_CONF} as c, b = truth as ok from {_P} p) select round(avg((c - ok::int) * (c - ok::int)), 9) as brier, round(-avg(case when ok then ln(c) else ln(1 - c) end), 9) as log_loss, count(*) filter (not ok and c >= 0.9::double) as confident_errors from c""")
def e8_losses(spark, sf_dir):
    c = _p(spark, sf_dir).select(((F.col("conf16") - 0.5) / 16).alias("c"), (F.col("b") == F.col("truth")).alias("ok"))
    off = F.col("c") - F.col("ok").cast("int")
    return c.agg(F.round(F.avg(off * off), 9).alias("brier"), F.round(-F.avg(F.when(F.col("ok"), F.log("c")).otherwise(F.log(1 - F.col("c")))), 9).alias("log_loss"), F.count_if(~F.col("ok") & (F.col("c") >= 0.9)).alias("confident_errors"))


@query("evl_e8_risk_coverage", f"""with r as (select b <> truth as bad, row_number() over (order by conf16 desc, flow_id) as rn, count(*) over () as n from {_P} p), c as (select unnest([0.5, 0.8, 0.9, 1.0]) as coverage)
select coverage::double as coverage, count(*) filter (rn <= greatest(1, floor(n * coverage))) as kept, count(*) filter (bad and rn <= greatest(1, floor(n * coverage))) as wrong from r, c group by 1""")
def e8_risk(spark, sf_dir):
    return M.risk_at_coverage(_p(spark, sf_dir).withColumn("bad", F.col("b") != F.col("truth")), "conf16", "bad", "flow_id", [0.5, 0.8, 0.9, 1.0])


_WEIGHT = "cast(cast('0x' || substr(sha256(rep || '|' || grp), 1, 15) as bigint) % 3 as bigint)"


@query("evl_e9_paired_interval", f"""with g as (select grp, count(*) n, count(*) filter (bt = truth) - count(*) filter (b = truth) as d from {_P} p group by 1), r as (select unnest(range(500)) as rep), w as (select rep, n, d, {_WEIGHT} as w from g, r),
s as (select rep, sum(w * d) / sum(w * n) as diff from w group by 1) select count(*) as replicates, round(quantile_cont(diff, 0.025), 9) as low, round(quantile_cont(diff, 0.975), 9) as high from s""")
def e9(spark, sf_dir):
    """A paired difference of accuracies over groups: counts of each group, weighed anew for each replicate, and the middle 95 %."""
    right = lambda c: F.count_if(F.col(c) == F.col("truth"))
    g = _p(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), (right("bt") - right("b")).alias("d"))
    w = g.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(499).cast("long"))))
    weight = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", "rep", "grp"), 256), 1, 15), 16, 10).cast("long"), F.lit(3))
    s = w.groupBy("rep").agg((F.sum(weight * F.col("d")) / F.sum(weight * F.col("n"))).alias("diff"))
    return P.quantiles(s, "diff", {"low": 0.025, "high": 0.975}).select(F.col("n").alias("replicates"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("evl_e12_mahalanobis")
def e12(spark, sf_dir):
    """No SQL: an inverse matrix; held against numpy in the tests."""
    e = read(spark, sf_dir, "embeddings")
    return M.nearest_class(e, "vec_id", "embedding", M.geometry(e, "label", "embedding"))


@query("evl_e14_information", f"""with j as (select dport as x, label as y, count(*) as n from {FLOWS_SQL} f group by all), t as (select *, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny, sum(n) over () as t from j) select round(sum(n / t * ln(n * t / (nx * ny))), 9) as information from t""")
def e14(spark, sf_dir):
    return M.mutual_information(flows(spark, sf_dir), "dport", "label").select(F.round("information", 9).alias("information"))


@query("evl_e14_shuffled", f"""with s as (select flow_id, dport, label, row_number() over (order by flow_id) as a, row_number() over (order by sha256('s' || flow_id)) as b from {FLOWS_SQL} f), m as (select x.dport, y.label from s x join s y on x.a = y.b), j as (select dport as x, label as y, count(*) as n from m group by all),
t as (select *, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny, sum(n) over () as t from j) select round(sum(n / t * ln(n * t / (nx * ny))), 9) as information from t""")
def e14_shuffled(spark, sf_dir):
    """What the information is by chance: labels dealt anew, in order of a seeded digest; ranks by range, not in one window."""
    f = flows(spark, sf_dir).select("flow_id", "dport", "label", F.lit(1).alias("one"), F.conv(F.substring(F.sha2(F.concat(F.lit("s"), F.col("flow_id").cast("string")), 256), 1, 15), 16, 10).cast("long").alias("h"))
    x = P.running_by_range(f, "flow_id", {"rank": "one"}).select("rank", "dport")
    y = P.running_by_range(f, "h", {"rank": "one"}, tie="flow_id").select("rank", "label")
    return M.mutual_information(x.join(y, "rank"), "dport", "label").select(F.round("information", 9).alias("information"))


@query("evl_e15_gates", f"""with s as (select count(*) as n, count(*) filter ({_flags()['help']}) as help, count(*) filter ({_flags()['harm']}) as harm, count(distinct truth) as classes from {_P} p)
select gate, passed from (select unnest([{{'gate': 'support', 'passed': n >= 100}}, {{'gate': 'gain', 'passed': help > harm}}, {{'gate': 'safety', 'passed': harm * 20 <= n}}, {{'gate': 'classes', 'passed': classes >= 3}},
 {{'gate': 'ALL', 'passed': n >= 100 and help > harm and harm * 20 <= n and classes >= 3}}], recursive := true) from s)""")
def e15(spark, sf_dir):
    p = _p(spark, sf_dir)
    row = p.agg(F.count("*").alias("n"), F.count_if(F.expr(_flags()["help"])).alias("help"), F.count_if(F.expr(_flags()["harm"])).alias("harm"), F.count_distinct("truth").alias("classes"))
    return M.gates(row, {"support": F.col("n") >= 100, "gain": F.col("help") > F.col("harm"), "safety": F.col("harm") * 20 <= F.col("n"), "classes": F.col("classes") >= 3})


# --- built of the above --------------------------------------------------------------------------------------------------


@query("cmp_x2_role_isolation", f"""with r as (select distinct src, label as role from {FLOWS_SQL} f) select a.role as one, b.role as other, count(*) as shared from r a join r b on a.src = b.src and a.role < b.role group by 1, 2""")
def x2(spark, sf_dir):
    """For each two roles how many keys they share: a key's roles are one set, of a handful at most, and its pairs are counted."""
    sets = flows(spark, sf_dir).groupBy("src").agg(F.collect_set("label").alias("r"))
    pairs = F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: b > a), lambda b: F.struct(a.alias("one"), b.alias("other")))))
    return sets.select(F.explode(pairs).alias("x")).groupBy("x.one", "x.other").agg(F.count("*").alias("shared"))


@query("cmp_x3_snapshot_stage", f"""with b as (select flow_id, label, cast(cast('0x' || substr(sha256('snap' || flow_id), 1, 15) as bigint) % 100 as bigint) as bucket from {FLOWS_SQL} f) select label, bucket % 4 as stage, count(*) as n, count(*) filter (bucket < 7) as retrieval from b group by 1, 2""")
def x3(spark, sf_dir):
    """One stage of evidence for each session by a hash bucket, and 7 in 100 with retrieval."""
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit("snap"), F.col("flow_id").cast("string")), 256), 1, 15), 16, 10).cast("long") % 100
    b = flows(spark, sf_dir).withColumn("bucket", bucket)
    return b.groupBy("label", (F.col("bucket") % 4).alias("stage")).agg(F.count("*").alias("n"), F.count_if(F.col("bucket") < 7).alias("retrieval"))


@query("cmp_x4_purification", f"""with c as (select rotation, count(*) as n, count(*) filter (truth = 'error') as pure, count(*) filter (truth <> 'error' and score > 2000) as dirty, (select count(*) from {_P} q where q.rotation = p.rotation and truth = 'error') as every from {_P} p where rejected_post group by rotation)
select round(avg(pure / n), 9) as purity, round(avg(dirty / n), 9) as contamination, round(avg(pure / every), 9) as retention, count(*) as rotations from c""")
def x4(spark, sf_dir):
    """Purity, contamination and retention of what was rejected, for each rotation and then on average."""
    bad, kept = F.col("truth") == "error", F.col("rejected_post")
    c = _p(spark, sf_dir).groupBy("rotation").agg(F.count_if(kept).alias("n"), F.count_if(kept & bad).alias("pure"), F.count_if(kept & ~bad & (F.col("score") > 2000)).alias("dirty"), F.count_if(bad).alias("every")).where("n > 0")
    return c.agg(*[F.round(F.avg(F.col(a) / F.col(b)), 9).alias(o) for a, b, o in (("pure", "n", "purity"), ("dirty", "n", "contamination"), ("pure", "every", "retention"))], F.count("*").alias("rotations"))


def _x5(family: str, others: tuple[str, str]) -> dict[str, str]:
    wrong = "b <> truth"
    return {"help": f"{wrong} and {family} = truth", "harm": f"b = truth and {family} <> truth", "unique_help": f"{wrong} and {family} = truth and {others[0]} <> truth and {others[1]} <> truth"}


_X5 = {"T": _x5("bt", ("br", "btr")), "R": _x5("br", ("bt", "btr")), "TR": _x5("btr", ("bt", "br"))}


@query("cmp_x5_specialisation", " union all ".join(f"select truth, '{f}' as family, count(*) as n, {', '.join(f'count(*) filter ({w}) as {n}' for n, w in c.items())}, count(*) filter (action = '{f}') as acquired from {_P} p group by 1" for f, c in _X5.items()))
def x5(spark, sf_dir):
    cells = [F.struct(F.lit(f).alias("family"), F.count("*").alias("n"), *[F.count_if(F.expr(w)).alias(n) for n, w in c.items()], F.count_if(F.col("action") == f).alias("acquired")).alias(f) for f, c in _X5.items()]
    return _p(spark, sf_dir).groupBy("truth").agg(*cells).select("truth", F.explode(F.array(*_X5)).alias("x")).select("truth", "x.*")


@query("cmp_x6_covered_draws", f"""with g as (select grp, count(*) filter (truth = 'error') as p, count(*) filter (truth <> 'error') as q from (select *, grp as g0 from {_P} z where grp < 6) p group by 1), r as (select unnest(range(200)) as rep), w as (select rep, p, q, {_WEIGHT} as w from g, r), s as (select rep, sum(w * p) as p, sum(w * q) as q from w group by 1)
select count(*) filter (p > 0 and q > 0) as kept, count(*) filter (p = 0 or q = 0) as dropped, cast(sum(p) filter (p > 0 and q > 0) as bigint) as positives, cast(sum(q) filter (p > 0 and q > 0) as bigint) as negatives from s""")
def x6(spark, sf_dir):
    """Replicates that lack one of the two classes are dropped and counted."""
    bad = F.col("truth") == "error"
    g = _p(spark, sf_dir).where("grp < 6").groupBy("grp").agg(F.count_if(bad).alias("p"), F.count_if(~bad).alias("q"))
    w = g.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))))
    weight = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", "rep", "grp"), 256), 1, 15), 16, 10).cast("long"), F.lit(3))
    s = w.groupBy("rep").agg(F.sum(weight * F.col("p")).alias("p"), F.sum(weight * F.col("q")).alias("q")).withColumn("ok", (F.col("p") > 0) & (F.col("q") > 0))
    return s.agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("dropped"), F.sum(F.when(F.col("ok"), F.col("p"))).alias("positives"), F.sum(F.when(F.col("ok"), F.col("q"))).alias("negatives"))


@query("cmp_x7_margin_gain")
def x7(spark, sf_dir):
    """No SQL: the distances need an inverse matrix. Per class, how often the nearest class is the true one, and the mean margin."""
    e = read(spark, sf_dir, "embeddings")
    near = M.nearest_class(e, "vec_id", "embedding", M.geometry(e, "label", "embedding"))
    x = e.select("vec_id", F.col("label").cast("string").alias("truth")).join(near, "vec_id")
    return x.groupBy("truth").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("truth")).alias("right"), F.avg("margin").alias("margin"))


@query("cmp_x8_class_stage", f"""with a as (select flow_id, truth, b, flow_id % 4 as stage from {_P} p), c as (select flow_id, bt from {_P} p where flow_id % 6 <> 0), f as (select flow_id, rejected_pre as available from {_P} p where flow_id % 9 <> 0)
select truth, stage, count(*) as n, count(*) filter (b = truth) as before_ok, count(*) filter (bt = truth) as after_ok, count(*) filter (available) as available from a join c using (flow_id) join f using (flow_id) group by 1, 2""")
def x8(spark, sf_dir):
    p = _p(spark, sf_dir)
    a, c = p.select("flow_id", "truth", "b", (F.col("flow_id") % 4).alias("stage")), p.where("flow_id % 6 <> 0").select("flow_id", "bt")
    j = a.join(c, "flow_id").join(p.where("flow_id % 9 <> 0").select("flow_id", F.col("rejected_pre").alias("available")), "flow_id")
    return j.groupBy("truth", "stage").agg(F.count("*").alias("n"), F.count_if(F.col("b") == F.col("truth")).alias("before_ok"), F.count_if(F.col("bt") == F.col("truth")).alias("after_ok"), F.count_if("available").alias("available"))


@query("cmp_x9_unpivot", f"""with w as (select label, count(*) filter (dport < 4) as low, count(*) filter (dport between 4 and 8) as middle, count(*) filter (dport > 8) as high from {FLOWS_SQL} f group by 1), u as (unpivot w on low, middle, high into name metric value n),
t as (select label, count(*) as test_n from {FLOWS_SQL} f where src % 2 = 0 and label <> 'view' group by 1) select coalesce(u.label, t.label) as label, metric, n, test_n from u full join t on u.label = t.label""")
def x9(spark, sf_dir):
    """Wide counts made long, and an outer join of two key sets."""
    f, d = flows(spark, sf_dir), F.col("dport")
    w = f.groupBy("label").agg(F.count_if(d < 4).alias("low"), F.count_if(d.between(4, 8)).alias("middle"), F.count_if(d > 8).alias("high"))
    t = f.where("src % 2 = 0 and label <> 'view'").groupBy("label").agg(F.count("*").alias("test_n"))
    return w.unpivot("label", ["low", "middle", "high"], "metric", "n").join(t, "label", "full")


@query("cmp_x11_flat_failures", f"select src as class, dst as stage, count(*) as n, cast(sum(bytes) as bigint) as weight from {FLOWS_SQL} f where src < 50 group by 1, 2")
def x11(spark, sf_dir):
    """Nested lists of failures as JSON, flattened to a matrix again."""
    inner = F.collect_list(F.struct(F.col("dst").alias("stage"), F.col("bytes").alias("weight")))
    doc = flows(spark, sf_dir).where("src < 50").groupBy("src").agg(F.to_json(F.struct(F.col("src").alias("class"), inner.alias("failures"))).alias("value"))
    v = doc.select(F.from_json("value", "class long, failures array<struct<stage: long, weight: long>>").alias("v"))
    return v.select("v.class", F.explode("v.failures").alias("f")).groupBy("class", "f.stage").agg(F.count("*").alias("n"), F.sum("f.weight").alias("weight"))


@query("evl_e13_forest")
def e13(spark, sf_dir):
    """No SQL: a fitted forest. Learned from two thirds of the rows, counted on the others by class."""
    from tidewell.operators import models

    rows, features = flows(spark, sf_dir).withColumn("kind", F.when(F.col("bytes") > 600, "large").otherwise("small")), ["packets", "dport", "bytes"]
    told = models.classify(models.fit_forest(rows.where("flow_id % 3 <> 0"), features, "kind", 10, 4), rows.where("flow_id % 3 = 0"), features)
    return told.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == F.col("predicted")).alias("right"))
