"""Sessionization, splits, sampling, sorts and top-k."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import selection as P
from tidewell.operators import sessions as S
from tidewell.operators import splits as G
from tidewell.plans.registry import query, read
from tidewell.sources.flows import FLOWS_SQL, flows

_HOUR = 3_600_000
_DIGEST = "sha256((start_ms // 300000) || '|' || least(src, dst) || '|' || greatest(src, dst))"


def _bucket(h: str, n: int) -> str:
    return f"cast(cast('0x' || substr({h}, 1, 15) as bigint) % {n} as integer)"


@query("ses_z1_idle_timeout", f"""with o as (select *, case when start_ms - max(end_ms) over (partition by src order by start_ms, flow_id rows between unbounded preceding and 1 preceding) > {6 * _HOUR} then 1 else 0 end as o from {FLOWS_SQL} f), s as (select *, sum(o) over (partition by src order by start_ms, flow_id rows unbounded preceding) as session from o)
select src, cast(session as bigint) as session, count(*) as flows, min(start_ms) as begin_ms, max(end_ms) as finish_ms, cast(sum(bytes) as bigint) as bytes from s group by all""")
def z1(spark, sf_dir):
    s = S.sessionize(flows(spark, sf_dir), ["src"], "start_ms", "end_ms", 6 * _HOUR, "flow_id")
    return s.groupBy("src", "session").agg(F.count("*").alias("flows"), F.min("start_ms").alias("begin_ms"), F.max("end_ms").alias("finish_ms"), F.sum("bytes").alias("bytes"))


def _z2(keys: str) -> str:
    return f"(with o as (select *, case when start_ms - lag(start_ms) over (partition by {keys} order by flow_id) > 86400000 then 1 else 0 end as o from (select *, least(src, dst) low, greatest(src, dst) high from {FLOWS_SQL} f) f), e as (select *, sum(o) over (partition by {keys} order by flow_id rows unbounded preceding) as ep from o) select count(*) from (select distinct {keys}, ep from e))"


@query("ses_z2_gap_episodes", f"select 'directed' as keying, {_z2('src, dst')} as episodes union all select 'unordered', {_z2('low, high')} union all select 'host', {_z2('src')}")
def z2(spark, sf_dir):
    f = flows(spark, sf_dir).select("*", *S.unordered("src", "dst"))
    count = lambda name, keys: S.gap_groups(f, keys, "start_ms", "flow_id", 86_400_000).select(*keys, "episode").distinct().agg(F.lit(name).alias("keying"), F.count("*").alias("episodes"))
    return count("directed", ["src", "dst"]).union(count("unordered", ["low", "high"])).union(count("host", ["src"])).select("keying", "episodes")


@query("ses_z3_clusters", f"with d as (select src, start_ms, flow_id, case when start_ms - lag(start_ms) over (partition by src order by start_ms, flow_id) > 3600000 then 1 else 0 end o from {FLOWS_SQL} f) select flow_id, cast(sum(o) over (partition by src order by start_ms, flow_id rows unbounded preceding) as bigint) as episode from d")
def z3(spark, sf_dir):
    f = flows(spark, sf_dir).withColumn("ordinal", F.struct("start_ms", "flow_id"))
    return S.gap_groups(f, ["src"], "start_ms", "ordinal", _HOUR).select("flow_id", "episode")


@query("ses_z4_activity_group", f"select flow_id, {_DIGEST} as grp from {FLOWS_SQL} f")
def z4(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", S.activity_group("start_ms", "src", "dst").alias("grp"))


@query("spl_z5_chronological", f"""with b as (select *, min(start_ms) over (partition by src % 4) lo, max(end_ms) over (partition by src % 4) hi from {FLOWS_SQL} f), c as (select *, lo + (hi - lo) * 0.70::double x, lo + (hi - lo) * 0.85::double y from b)
select flow_id, case when end_ms <= x - 1800000 then 'train' when start_ms >= x + 1800000 and end_ms <= y - 1800000 then 'validation' when start_ms >= y + 1800000 then 'test' else 'quarantine' end as split from c""")
def z5(spark, sf_dir):
    """The ends of each capture are aggregated and joined, so that no task holds a capture."""
    f = flows(spark, sf_dir).withColumn("capture", F.col("src") % 4)
    ends = f.groupBy("capture").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"))
    return f.join(ends, "capture").select("flow_id", S.chronological_split("start_ms", "end_ms", F.col("lo"), F.col("hi"), _HOUR).alias("split"))


@query("spl_z6_gap_chooser", f"""with d as (select src % 4 as capture, quantile_cont(end_ms - start_ms, 0.999) as q, max(end_ms) - min(start_ms) as span from {FLOWS_SQL} f group by 1)
select capture, cast(least(greatest(5000, ceil(q)), floor(span * 0.02::double)) as bigint) as gap from d""")
def z6(spark, sf_dir):
    f = flows(spark, sf_dir).select((F.col("src") % 4).alias("capture"), (F.col("end_ms") - F.col("start_ms")).alias("d"), "start_ms", "end_ms")
    spans = f.groupBy("capture").agg((F.max("end_ms") - F.min("start_ms")).alias("span"))
    d = G.quantiles(f, "d", {"q": 0.999}, ["capture"]).join(spans, "capture")
    return d.select("capture", F.least(F.greatest(F.lit(5000), F.ceil("q")), F.floor(F.col("span") * F.lit(0.02))).cast("long").alias("gap"))


@query("spl_z8_rank_boundaries", f"with r as (select src % 4 as capture, start_ms, row_number() over (partition by src % 4 order by start_ms, flow_id) rn, count(*) over (partition by src % 4) n from {FLOWS_SQL} f) select capture, max(start_ms) filter (rn = least(n, n * 7 // 10 + 1)) as first_ms, max(start_ms) filter (rn = least(n, n * 85 // 100 + 1)) as second_ms from r group by 1")
def z8(spark, sf_dir):
    """Ranks from the counts of distinct times by range."""
    by = flows(spark, sf_dir).groupBy((F.col("src") % 4).alias("capture"), "start_ms").agg(F.count("*").alias("c"))
    run = G.running_by_range(by, "start_ms", {"under": "c"}, groups=["capture"]).join(by.groupBy("capture").agg(F.sum("c").alias("n")), "capture")
    rank = lambda a, b: F.least(F.col("n"), F.floor(F.col("n") * a / b) + 1)
    at = lambda a, b: F.max(F.when((F.col("under") < rank(a, b)) & (rank(a, b) <= F.col("under") + F.col("c")), F.col("start_ms")))
    return run.groupBy("capture").agg(at(7, 10).alias("first_ms"), at(85, 100).alias("second_ms"))


@query("spl_z9_embargo", f"with b as (select *, 1705276800000 as x, 1705881600000 as y from {FLOWS_SQL} f) select flow_id, case when end_ms <= x - 3600000 then 'train' when start_ms >= x + 3600000 and end_ms <= y - 3600000 then 'validation' when start_ms >= y + 3600000 then 'test' else 'quarantine' end as split from b")
def z9(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", S.embargo_split("start_ms", "end_ms", F.lit(1705276800000), F.lit(1705881600000), 2 * _HOUR).alias("split"))


@query("spl_z10_hash_split", f"with g as (select flow_id, {_DIGEST} as h from {FLOWS_SQL} f) select flow_id, case when {_bucket('h', 100)} < 70 then 'train' when {_bucket('h', 100)} < 85 then 'validation' else 'test' end as split, {_bucket('h', 5)} as fold from g")
def z10(spark, sf_dir):
    g = flows(spark, sf_dir).select("flow_id", S.activity_group("start_ms", "src", "dst").alias("h"))
    return g.select("flow_id", S.hash_split(F.col("h")).alias("split"), S.bucket(F.col("h"), 5).alias("fold"))


@query("spl_z12_group_chunks", f"""with g as (select label, dport, count(*) n, min(start_ms) first from {FLOWS_SQL} f group by all), c as (select *, sum(n) over (partition by label order by first, dport rows between unbounded preceding and 1 preceding) as before, sum(n) over (partition by label) as total from g)
select label, dport, n, cast(least(2, coalesce(before, 0) * 3 // total) as bigint) as fold from c""")
def z12(spark, sf_dir):
    g = flows(spark, sf_dir).groupBy("label", "dport").agg(F.count("*").alias("n"), F.min("start_ms").alias("first"))
    w = Window.partitionBy("label")
    before = F.coalesce(F.sum("n").over(w.orderBy("first", "dport").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.select("label", "dport", "n", F.least(F.lit(2), F.floor(before * 3 / F.sum("n").over(w))).cast("long").alias("fold"))


@query("spl_z13_fold_leakage", f"with g as (select src, {_bucket('sha256(src::varchar)', 5)} as fold from {FLOWS_SQL} f), p as (select src, count(*) as n, min(fold) as a, max(fold) as b from g group by 1) select a as fold, sum(n)::bigint as held_out, count(*) as groups, count(*) filter (a <> b) as leaked from p group by 1")
def z13(spark, sf_dir):
    g = flows(spark, sf_dir).select("src", S.bucket(F.sha2(F.col("src").cast("string"), 256), 5).alias("fold"))
    per = g.groupBy("src").agg(F.count("*").alias("n"), F.min("fold").alias("fold"), F.max("fold").alias("other"))
    return per.groupBy("fold").agg(F.sum("n").alias("held_out"), F.count("*").alias("groups"), F.count_if(F.col("fold") != F.col("other")).alias("leaked"))


@query("smp_z16_representative", "with r as (select doc_id, sha256(text) as h, row_number() over (partition by sha256(text) order by sha256('s|' || doc_id), doc_id) rn from documents) select doc_id, h from r where rn = 1")
def z16(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return P.representative(d, ["h"], [P.seeded("s", "doc_id"), "doc_id"]).select("doc_id", "h")


@query("smp_z18_staged_selection", f"""with f as (select *, sha256('z|' || flow_id) as rk from {FLOWS_SQL} f), a as (select *, row_number() over (partition by label, dst order by rk, flow_id) k from f), b as (select *, row_number() over (partition by label order by case when k = 1 then 0 else 1 end, rk, flow_id) pick from a)
select label, flow_id, case when k = 1 then 1 else 2 end as stage from b where pick <= 150""")
def z18(spark, sf_dir):
    f = flows(spark, sf_dir).withColumn("rk", P.seeded("z", "flow_id"))
    a = f.withColumn("k", F.row_number().over(Window.partitionBy("label", "dst").orderBy("rk", "flow_id")))
    a = a.withColumn("stage", F.when(F.col("k") == 1, 1).otherwise(2))
    return P.head(a, ["label"], ["stage", "rk", "flow_id"], 150).select("label", "flow_id", "stage")


@query("smp_z19_round_robin", f"""with r as (select *, row_number() over (partition by label, dport order by start_ms, flow_id) as round from {FLOWS_SQL} f), p as (select *, row_number() over (partition by label order by round, dport) as pick from r) select label, flow_id, round, pick from p where pick <= 40""")
def z19(spark, sf_dir):
    return P.round_robin(flows(spark, sf_dir), ["label"], ["dport"], ["start_ms", "flow_id"], ["dport"], 40).select("label", "flow_id", F.col("round").cast("long").alias("round"), F.col("pick").cast("long").alias("pick"))


@query("smp_z20_balanced_cells", f"""with u as (select * from {FLOWS_SQL} f where flow_id % 11 <> 0), r as (select *, least(9, bytes // 1000) as bin, row_number() over (partition by label, least(9, bytes // 1000) order by sha256('b|' || flow_id), flow_id) as round from u), p as (select *, row_number() over (order by round, label, bin) as pick from r where round <= 100) select flow_id, label, cast(bin as bigint) as bin from p where pick <= 100""")
def z20(spark, sf_dir):
    f = flows(spark, sf_dir)
    used = f.where("flow_id % 11 = 0").select("flow_id")
    u = f.join(used, "flow_id", "left_anti").withColumn("bin", F.least(F.lit(9), F.floor(F.col("bytes") / 1000)).cast("long"))
    r = P.head(u, ["label", "bin"], [P.seeded("b", "flow_id"), "flow_id"], 100)
    return r.orderBy("rank", "label", "bin").limit(100).select("flow_id", "label", "bin")


@query("smp_z22_first_distinct", "with d as (select lang, sha256(text) h, min(doc_id) as doc_id from documents group by all), r as (select *, row_number() over (partition by lang order by doc_id) rn from d) select lang, doc_id from r where rn <= 25")
def z22(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    return P.head(d, ["lang"], ["doc_id"], 25).select("lang", "doc_id")


@query("smp_z23_largest_remainder", f"""with c as (select start_ms // 604800000 as block, count(*) n from {FLOWS_SQL} f group by 1), q as (select *, n * 500 // sum(n) over () as fl, (n * 500) % sum(n) over () as rm from c), k as (select *, row_number() over (order by rm desc, block) k, 500 - sum(fl) over () as spare from q)
select block, n, cast(fl + case when k <= spare then 1 else 0 end as bigint) as quota from k""")
def z23(spark, sf_dir):
    c = flows(spark, sf_dir).groupBy(F.floor(F.col("start_ms") / 604_800_000).alias("block")).agg(F.count("*").alias("n"))
    return P.largest_remainder(c, "n", 500, ["block"]).select("block", "n", "quota")


@query("smp_z24_earliest", f"with r as (select *, row_number() over (partition by src, dst order by start_ms, flow_id) rn from {FLOWS_SQL} f) select flow_id, src, dst from r where rn = 1")
def z24(spark, sf_dir):
    return P.representative(flows(spark, sf_dir), ["src", "dst"], ["start_ms", "flow_id"]).select("flow_id", "src", "dst")


@query("smp_z26_head", "with r as (select *, row_number() over (partition by o_orderpriority order by o_orderkey) rn from orders) select o_orderpriority, o_orderkey from r where rn <= 50")
def z26(spark, sf_dir):
    return P.head(read(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderkey"], 50).select("o_orderpriority", "o_orderkey")


@query("smp_z27_trim", f"with m as (select *, min(flow_id) filter (label = 'error') over (partition by src) as stop from {FLOWS_SQL} f) select flow_id, src from m where flow_id <= stop")
def z27(spark, sf_dir):
    stop = F.min(F.when(F.col("label") == "error", F.col("flow_id"))).over(Window.partitionBy("src"))
    return flows(spark, sf_dir).withColumn("stop", stop).where("flow_id <= stop").select("flow_id", "src")


@query("smp_z28_shards", f"select doc_id, {_bucket('sha256(doc_id::varchar)', 16)} as shard from documents")
def z28(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", S.bucket(F.sha2(F.col("doc_id").cast("string"), 256), 16).alias("shard"))


@query("srt_t1_stable_order", "select o_orderkey, row_number() over (order by o_orderdate, o_custkey, o_orderkey) as position from orders qualify position <= 500")
def t1(spark, sf_dir):
    top = read(spark, sf_dir, "orders").orderBy("o_orderdate", "o_custkey", "o_orderkey").limit(500)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderdate", "o_custkey", "o_orderkey")).cast("long").alias("position"))


@query("srt_t2_topk_group", "select c_nationkey, c_custkey from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) <= 3")
def t2(spark, sf_dir):
    return P.head(read(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey")


@query("srt_t3_topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def t3(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("srt_t4_seeded", "select doc_id from documents order by sha256('7|' || doc_id), doc_id limit 100")
def t4(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").orderBy(P.seeded("7", "doc_id"), "doc_id").limit(100)
