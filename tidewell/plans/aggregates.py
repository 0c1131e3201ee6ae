"""Profiles, audits and dedup counts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import sessions as S
from tidewell.operators import splits as P
from tidewell.plans.registry import query, read
from tidewell.sources.flows import FLOWS_SQL, flows

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_FINITE = "{c} is not null and not isnan({c}) and abs({c}) < 1e308"


@query("agg_a1_profile", " union all ".join(f"select '{c}' as name, count(*) as n, count(*) filter ({c} is null) as nulls, count(*) filter ({c} = 0) as zeros, count(*) filter ({c} < 0) as negatives, min({c}) filter ({_FINITE.format(c=c)}) as least, max({c}) filter ({_FINITE.format(c=c)}) as most, count(distinct {c}) as cardinality from lineitem" for c in _NUM))
def a1(spark, sf_dir):
    """All columns in one pass: the wide row of aggregates is then turned to rows."""
    rows, finite = read(spark, sf_dir, "lineitem"), lambda c: F.expr(_FINITE.format(c=c))
    aggs = [F.struct(F.lit(c).alias("name"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.col(c) == 0).alias("zeros"), F.count_if(F.col(c) < 0).alias("negatives"), F.min(F.when(finite(c), F.col(c))).alias("least"), F.max(F.when(finite(c), F.col(c))).alias("most"), F.count_distinct(c).alias("cardinality")).alias(c) for c in _NUM]
    return rows.agg(*aggs).select(F.explode(F.array(*_NUM)).alias("x")).select("x.*")


@query("agg_a2_violations", f"select count(*) filter (end_ms < start_ms) as reversed, count(*) filter (bytes < packets) as thin, count(*) filter ((label = 'error') <> (bytes > 5000)) as mismatched from {FLOWS_SQL} f")
def a2(spark, sf_dir):
    return flows(spark, sf_dir).agg(F.count_if(F.col("end_ms") < F.col("start_ms")).alias("reversed"), F.count_if(F.col("bytes") < F.col("packets")).alias("thin"), F.count_if((F.col("label") == "error") != (F.col("bytes") > 5000)).alias("mismatched"))


@query("agg_a3_order_violations", f"with g as (select src, end_ms - lag(end_ms) over (partition by src order by flow_id) as d from {FLOWS_SQL} f) select src, count(*) filter (d < 0) as violations from g group by src")
def a3(spark, sf_dir):
    step = F.col("end_ms") - F.lag("end_ms").over(Window.partitionBy("src").orderBy("flow_id"))
    return flows(spark, sf_dir).withColumn("d", step).groupBy("src").agg(F.count_if(F.col("d") < 0).alias("violations"))


@query("agg_a4_duplicate_lines", "with g as (select sha256(text) h, count(*) c from documents group by 1) select cast(coalesce(sum(c - 1), 0) as bigint) as beyond_first, count(*) filter (c > 1) as groups, coalesce(max(c), 0) as multiplicity from g")
def a4(spark, sf_dir):
    g = read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("c"))
    return g.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("beyond_first"), F.count_if(F.col("c") > 1).alias("groups"), F.coalesce(F.max("c"), F.lit(0)).alias("multiplicity"))


@query("agg_a5_digest_audit", "select sha256(text) as digest, count(*) as copies, min(doc_id) as first_id, max(doc_id) as last_id, count(distinct source) as sources, count(distinct lang) > 1 as conflict from documents group by 1")
def a5(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_distinct("source").alias("sources"), (F.count_distinct("lang") > 1).alias("conflict"))


@query("agg_a6_identity_dedup", """with r as (select l_orderkey, l_linenumber, l_returnflag, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) rn from lineitem),
g as (select l_orderkey, l_linenumber, count(distinct l_returnflag) k from r group by all)
select case when k > 1 then 'conflict' when rn > 1 then 'duplicate' else 'retained' end as outcome, count(*) as n from r join g using (l_orderkey, l_linenumber) group by 1""")
def a6(spark, sf_dir):
    """One shuffle: the group's flags are window aggregates over the same key."""
    w = Window.partitionBy("l_orderkey", "l_linenumber")
    rows = read(spark, sf_dir, "lineitem").withColumns({"rn": F.row_number().over(w.orderBy("l_partkey", "l_suppkey", "l_extendedprice")), "low": F.min("l_returnflag").over(w), "high": F.max("l_returnflag").over(w)})
    outcome = F.when(F.col("low") != F.col("high"), "conflict").when(F.col("rn") > 1, "duplicate").otherwise("retained")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


_SPLIT = "case when l_shipdate < timestamp '1998-01-01' then 'train' when l_shipdate < timestamp '2000-01-01' then 'validation' else 'test' end"


@query("agg_a7_leakage", f"""with r as (select *, {_SPLIT} as split from lineitem), g as (select 'order' as signature, cast(l_orderkey as varchar) as v, split from r union all select 'part', cast(l_partkey as varchar), split from r union all select 'pair', l_partkey || '-' || l_suppkey, split from r),
h as (select signature, v, count(distinct split) as k from g group by all) select signature, count(*) as groups, count(*) filter (k > 1) as crossing from h group by 1""")
def a7(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("split", F.expr(_SPLIT))
    s = lambda n, *c: F.struct(F.lit(n).alias("signature"), F.concat_ws("-", *c).alias("v"))
    long = rows.select("split", F.explode(F.array(s("order", "l_orderkey"), s("part", "l_partkey"), s("pair", "l_partkey", "l_suppkey"))).alias("x")).select("split", "x.*")
    bit = F.when(F.col("split") == "train", 1).when(F.col("split") == "validation", 2).otherwise(4)
    return long.groupBy("signature", "v").agg(F.bit_or(bit).alias("m")).groupBy("signature").agg(F.count("*").alias("groups"), F.count_if(F.bit_count("m") > 1).alias("crossing"))


@query("agg_a8_counts", "select event_type, cast(user_id % 4 as bigint) as capture, count(*) as n from events group by grouping sets ((event_type), (user_id % 4), (event_type, user_id % 4), ())")
def a8(spark, sf_dir):
    """All breakdowns from one pass over the rows."""
    e = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("capture"))
    return e.groupingSets([[F.col("event_type")], [F.col("capture")], [F.col("event_type"), F.col("capture")], []], "event_type", "capture").agg(F.count("*").alias("n")).select("event_type", "capture", "n")


@query("agg_a9_split_policies", f"""with p as (select 'time' as policy, src as grp, label, case when start_ms % 10 < 7 then 'train' else 'test' end as split from {FLOWS_SQL} f union all select 'host', src, label, case when src % 10 < 7 then 'train' else 'test' end from {FLOWS_SQL} g union all select 'port', src, label, case when dport % 10 < 7 then 'train' else 'test' end from {FLOWS_SQL} h)
select policy, count(*) filter (split = 'train') as train, count(*) filter (split = 'test') as test, count(distinct grp) as groups, (select count(*) from (select grp from p q where q.policy = p.policy group by grp having count(distinct split) > 1)) as crossing from p group by policy""")
def a9(spark, sf_dir):
    bit = lambda c: F.when(F.col(c) % 10 < 7, 1).otherwise(2)
    policies = F.array(*[F.struct(F.lit(n).alias("policy"), bit(c).alias("bit")) for n, c in (("time", "start_ms"), ("host", "src"), ("port", "dport"))])
    long = flows(spark, sf_dir).select("src", F.explode(policies).alias("x")).select("src", "x.*")
    by = long.groupBy("policy", "src").agg(F.count_if(F.col("bit") == 1).alias("a"), F.count_if(F.col("bit") == 2).alias("b"), F.bit_or("bit").alias("m"))
    return by.groupBy("policy").agg(F.sum("a").alias("train"), F.sum("b").alias("test"), F.count("*").alias("groups"), F.count_if(F.bit_count("m") > 1).alias("crossing"))


@query("agg_a10_readiness", f"""with c as (select l_returnflag as label, {_SPLIT} as split, count(*) as n, count(distinct l_orderkey) as exact, count(distinct l_partkey) as near from lineitem group by all)
select label, split, n, exact, near, case when near = 0 then 'ZERO' when near < 30 then 'CRITICAL_LOW' when near < 100 then 'LOW' else 'ADEQUATE' end as support from c""")
def a10(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.expr(_SPLIT).alias("split")).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("exact"), F.count_distinct("l_partkey").alias("near"))
    return c.withColumn("support", F.when(F.col("near") == 0, "ZERO").when(F.col("near") < 30, "CRITICAL_LOW").when(F.col("near") < 100, "LOW").otherwise("ADEQUATE"))


@query("agg_a11_session_build", """with p as (select l_orderkey, l_linenumber, l_returnflag, cast(l_quantity as bigint) q, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn from lineitem)
select l_orderkey as session, count(*) as packets, count(*) filter (l_returnflag = 'N') as forward, cast(coalesce(sum(q) filter (l_returnflag = 'N'), 0) as bigint) as forward_bytes, min(q) as least, max(q) as most, cast(sum(q * q) as bigint) as squares, bit_or(q) as flags, string_agg(l_partkey, ',' order by rn) filter (rn <= 16) as first_parts from p group by 1""")
def a11(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").withColumns({"q": q, "rn": F.row_number().over(order)})
    ahead = F.col("l_returnflag") == "N"
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 16, F.struct("rn", "l_partkey")))), lambda x: x["l_partkey"].cast("string"))
    return rows.groupBy(F.col("l_orderkey").alias("session")).agg(F.count("*").alias("packets"), F.count_if(ahead).alias("forward"), F.coalesce(F.sum(F.when(ahead, F.col("q"))), F.lit(0)).alias("forward_bytes"), F.min("q").alias("least"), F.max("q").alias("most"), F.sum(F.col("q") * F.col("q")).alias("squares"), F.bit_or("q").alias("flags"), F.array_join(first, ",").alias("first_parts"))


@query("agg_a13_gap_profile", f"""with g as (select src, start_ms - lag(start_ms) over (partition by src order by flow_id) as gap from {FLOWS_SQL} f)
select count(distinct src) as keys, count(gap) as gaps, count(*) filter (gap > 0) as positive, count(*) filter (gap < 0) as negative, max(gap) as most, cast(quantile_cont(gap, 0.5) filter (gap > 0) as bigint) as p50, cast(quantile_cont(gap, 0.9) filter (gap > 0) as bigint) as p90 from g""")
def a13(spark, sf_dir):
    g = flows(spark, sf_dir).withColumn("gap", F.col("start_ms") - F.lag("start_ms").over(Window.partitionBy("src").orderBy("flow_id")))
    p = P.quantiles(g.where("gap > 0"), "gap", {"p50": 0.5, "p90": 0.9}).select(*[F.rint(n).cast("long").alias(n) for n in ("p50", "p90")])  # halves to even, as the cast in SQL
    rest = g.agg(F.count_distinct("src").alias("keys"), F.count("gap").alias("gaps"), F.count_if(F.col("gap") > 0).alias("positive"), F.count_if(F.col("gap") < 0).alias("negative"), F.max("gap").alias("most"))
    return rest.crossJoin(p)


@query("agg_a14_episodes", f"""with o as (select *, case when start_ms - lag(start_ms) over (partition by src, dport order by flow_id) > 86400000 then 1 else 0 end as o from {FLOWS_SQL} f), e as (select *, sum(o) over (partition by src, dport order by flow_id rows unbounded preceding) as ep from o),
l as (select src, dport, ep, label, count(*) c from e group by all), s as (select src, dport, ep, sum(c) as n, max(c) as top, count(*) as labels from l group by all)
select count(*) as episodes, max(n)::bigint as largest, count(*) filter (labels = 1) as pure, sum(top)::bigint as dominant, sum(n)::bigint as flows from s""")
def a14(spark, sf_dir):
    e = S.gap_groups(flows(spark, sf_dir), ["src", "dport"], "start_ms", "flow_id", 86_400_000)
    s = e.groupBy("src", "dport", "episode", "label").agg(F.count("*").alias("c")).groupBy("src", "dport", "episode").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.count("*").alias("labels"))
    return s.agg(F.count("*").alias("episodes"), F.max("n").alias("largest"), F.count_if(F.col("labels") == 1).alias("pure"), F.sum("top").alias("dominant"), F.sum("n").alias("flows"))


@query("agg_a15_purity", f"with c as (select src, label, count(*) n from {FLOWS_SQL} f group by all) select src, max(n) as dominant, cast(sum(n) as bigint) as valid, max(n) * 10 >= sum(n) * 3 as passes from c group by src")
def a15(spark, sf_dir):
    c = flows(spark, sf_dir).groupBy("src", "label").agg(F.count("*").alias("n"))
    return c.groupBy("src").agg(F.max("n").alias("dominant"), F.sum("n").alias("valid"), (F.max("n") * 10 >= F.sum("n") * 3).alias("passes"))


@query("agg_a16_provenance", "select n_name as capture, count(o_orderkey) as sessions, count(distinct o_custkey) as hosts from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1")
def a16(spark, sf_dir):
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy(F.col("n_name").alias("capture")).agg(F.count("o_orderkey").alias("sessions"), F.count_distinct("o_custkey").alias("hosts"))


@query("agg_a17_technique_stats", f"""with c as (select label, dport, count(*) n from {FLOWS_SQL} f group by all), d as (select label, dport, n, row_number() over (partition by label order by n desc, dport) rn from c)
select f.label, count(*) as n, min(start_ms) as first_ms, max(start_ms) as last_ms, count(distinct start_ms // 86400000) as days, count(distinct src) as sources, max(d.dport) as top_port, max(d.n) as top_n from {FLOWS_SQL} f join d on d.label = f.label and d.rn = 1 group by f.label""")
def a17(spark, sf_dir):
    by = flows(spark, sf_dir)
    top = by.groupBy("label", "dport").agg(F.count("*").alias("k")).groupBy("label").agg(F.max(F.struct("k", (-F.col("dport")).alias("m"), "dport")).alias("t"))
    rest = by.groupBy("label").agg(F.count("*").alias("n"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"), F.count_distinct(F.floor(F.col("start_ms") / 86_400_000)).alias("days"), F.count_distinct("src").alias("sources"))
    return rest.join(top, "label").select("label", "n", "first_ms", "last_ms", "days", "sources", F.col("t.dport").alias("top_port"), F.col("t.k").alias("top_n"))


@query("agg_a18_crosstab", "select o_orderpriority as priority, " + ", ".join(f"count(*) filter (o_orderstatus = '{s}') as s_{s.lower()}" for s in "FOP") + " from orders group by 1")
def a18(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(*[F.count_if(F.col("o_orderstatus") == s).alias(f"s_{s.lower()}") for s in "FOP"])


@query("agg_a19_shortcut_tokens", """with t as (select distinct doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as token from documents), c as (select token, min(lang) as lang, count(distinct lang) as k, count(*) as support from t group by 1)
select token, lang, support from c where k = 1 and support >= 20""")
def a19(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))).alias("token"))
    c = t.groupBy("token").agg(F.min("lang").alias("lang"), F.max("lang").alias("high"), F.count("lang").alias("support"))
    return c.where((F.col("lang") == F.col("high")) & (F.col("support") >= 20)).select("token", "lang", "support")


@query("agg_a20_runtime_summary", f"select label as decision, count(*) as n, count(*) filter (bytes > 5000) as failures, cast(sum(packets) as bigint) as budget from {FLOWS_SQL} f group by 1")
def a20(spark, sf_dir):
    return flows(spark, sf_dir).groupBy(F.col("label").alias("decision")).agg(F.count("*").alias("n"), F.count_if(F.col("bytes") > 5000).alias("failures"), F.sum("packets").alias("budget"))


@query("agg_a21_length_report", """with l as (select n_chars, row_number() over (order by n_chars) rn, count(*) over () n from documents) select max(n) as n, cast(sum(n_chars) as bigint) as total,
 max(n_chars) filter (rn = greatest(1, ceil(0.5 * n))) as p50, max(n_chars) filter (rn = greatest(1, ceil(0.95 * n))) as p95, max(n_chars) as most, count(*) filter (n_chars > 8192) as overflow from l""")
def a21(spark, sf_dir):
    """Nearest ranks from the counts of distinct lengths by range, not from a sorted list of all."""
    by = read(spark, sf_dir, "documents").groupBy("n_chars").agg(F.count("*").alias("c"))
    up = P.running_by_range(by, "n_chars", {"under": "c"}).crossJoin(F.broadcast(by.agg(F.sum("c").alias("n"))))
    at = lambda q: F.min(F.when(F.col("under") + F.col("c") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n"))), F.col("n_chars")))
    return up.agg(F.max("n").alias("n"), F.sum(F.col("n_chars") * F.col("c")).alias("total"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("n_chars").alias("most"), F.coalesce(F.sum(F.when(F.col("n_chars") > 8192, F.col("c"))), F.lit(0)).alias("overflow"))


@query("agg_a22_logical_hash", "with r as (select lang, sha256(doc_id || '|' || text) as h from documents), b as (select lang, substr(h, 1, 4) as b, count(*) as n, sha256(string_agg(h, chr(10) order by h)) as d from r group by 1, 2) select lang, sum(n)::bigint as n, sha256(string_agg(b || ' ' || d, chr(10) order by b)) as digest from b group by 1")
def a22(spark, sf_dir):
    """Order-free digest of a partition: of its rows' digests by bucket, then of the buckets', 65,536 at most."""
    r = read(spark, sf_dir, "documents").select("lang", F.sha2(F.concat_ws("|", "doc_id", "text"), 256).alias("h"))
    lines = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    b = r.groupBy("lang", F.substring("h", 1, 4).alias("b")).agg(F.count("*").alias("n"), lines("h").alias("d"))
    return b.groupBy("lang").agg(F.sum("n").alias("n"), lines(F.concat_ws(" ", "b", "d")).alias("digest"))


@query("agg_a23_relation_anomaly", f"""with p as (select src % 4 as scope, dport as ip, dst % 20 as mac, count(*) n from {FLOWS_SQL} f group by all having count(*) >= 2), i as (select scope, ip, count(*) as macs from p group by all)
select scope, count(*) as ips, count(*) filter (macs >= 2) as contested, max(macs) as most from i group by 1""")
def a23(spark, sf_dir):
    p = flows(spark, sf_dir).groupBy((F.col("src") % 4).alias("scope"), F.col("dport").alias("ip"), (F.col("dst") % 20).alias("mac")).agg(F.count("*").alias("n")).where("n >= 2")
    return p.groupBy("scope", "ip").agg(F.count("*").alias("macs")).groupBy("scope").agg(F.count("*").alias("ips"), F.count_if(F.col("macs") >= 2).alias("contested"), F.max("macs").alias("most"))


@query("agg_a24_bounded_lists", f"with d as (select distinct src, dst from {FLOWS_SQL} f), r as (select *, row_number() over (partition by src order by dst) rn from d) select src, string_agg(dst, ',' order by dst) as dsts from r where rn <= 24 group by 1")
def a24(spark, sf_dir):
    d = flows(spark, sf_dir).select("src", "dst").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where("rn <= 24")
    return d.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("dsts"))
