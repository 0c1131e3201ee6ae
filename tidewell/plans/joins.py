"""Joins and set operations."""

from pyspark.sql import functions as F

from tidewell.operators import joins as J
from tidewell.plans.registry import query, read
from tidewell.sources.flows import FLOWS_SQL, flows

_EVENTS = f"(select 'e' || flow_id as event_id, start_ms - 600000 as start_ms, end_ms + 600000 as end_ms, src, dst, case when flow_id % 100 = 0 then null else dport end as dport, label from {FLOWS_SQL} f where flow_id % 50 = 0)"


def _events(f):
    e = f.where("flow_id % 50 = 0")
    return e.select(F.concat(F.lit("e"), "flow_id").alias("event_id"), (F.col("start_ms") - 600_000).alias("start_ms"), (F.col("end_ms") + 600_000).alias("end_ms"), "src", "dst", F.when(F.col("flow_id") % 100 != 0, F.col("dport")).alias("dport"), "label")


@query("join_j1_interval_match", f"""with f as {FLOWS_SQL}, e as {_EVENTS}, b as (select *, src as a, dst as b, 0 as back from e union all select *, dst, src, 1 from e),
h as (select f.flow_id, b.event_id, max(case when back = 1 then 'reverse_direction_time' when b.dport is null then 'wildcard_port_time' else 'exact_tuple_time' end) as rule, bool_and(f.label = b.label) as agrees
 from f join b on f.src = b.a and f.dst = b.b and b.start_ms <= f.end_ms and b.end_ms >= f.start_ms and (b.dport is null or b.dport = f.dport) and f.start_ms // 86400000 between b.start_ms // 86400000 and b.end_ms // 86400000 group by all),
g as (select flow_id, count(*) n, string_agg(event_id, ',' order by event_id) as event_ids, min(rule) as rule, bool_and(agrees) as agrees from h group by 1)
select f.flow_id, case when n is null then 'unmatched' when n = 1 then 'unique' else 'ambiguous' end as status, event_ids, case when n = 1 then rule end as rule, case when n = 1 then agrees end as agrees from f left join g using (flow_id)""")
def j1(spark, sf_dir):
    f = flows(spark, sf_dir)
    return J.match_events(f, _events(f))


@query("join_j2_range_join", f"""with f as {FLOWS_SQL}, m as (select a.flow_id, b.flow_id as other, row_number() over (partition by a.flow_id order by b.start_ms, b.flow_id) rn, a.packets from f a join f b on a.src = b.src and b.start_ms between a.start_ms - 2000 and a.end_ms + 7200000)
select flow_id, other from m where rn <= packets + 4""")
def j2(spark, sf_dir):
    f = flows(spark, sf_dir)
    left = f.select("flow_id", "src", "packets", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    right = f.select("src", F.col("flow_id").alias("other"), "start_ms")
    return J.range_join(left, right, ["src"], F.col("a") - 2000, F.col("b") + 7_200_000, "start_ms", F.col("packets") + 4, "other", "flow_id").select("flow_id", "other")


@query("join_j3_as_of", f"""with f as {FLOWS_SQL}, b as (select src, start_ms, max(flow_id) as session from f where flow_id % 4 = 0 group by all) select a.flow_id, b.session, b.start_ms as from_start_ms from f a asof left join b on a.src = b.src and a.start_ms >= b.start_ms""")
def j3(spark, sf_dir):
    f = flows(spark, sf_dir)
    right = f.where("flow_id % 4 = 0").select("src", "start_ms", F.col("flow_id").alias("session"))
    out = J.as_of(f.select("flow_id", "src", F.col("start_ms").alias("moment")), right, ["src"], "moment", "start_ms", ["session"], "session")
    return out.select("flow_id", "session", "from_start_ms")


@query("join_j4_rule_cascade", f"""with f as {FLOWS_SQL}, e as {_EVENTS}, m as (select e.event_id, f.flow_id, case when e.dst = f.dst and e.dport = f.dport then 0 when e.dst = f.dst then 1 when e.dport = f.dport then 2 else 3 end as rule from e join f on e.src = f.src and f.start_ms between e.start_ms and e.end_ms + 86400000)
select event_id, flow_id, rule from m qualify rule = min(rule) over (partition by event_id)""")
def j4(spark, sf_dir):
    f = flows(spark, sf_dir)
    e = _events(f).select("event_id", "src", F.col("dst").alias("e_dst"), F.col("dport").alias("e_dport"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    same_dst, same_port = F.col("e_dst") == F.col("dst"), F.coalesce(F.col("e_dport") == F.col("dport"), F.lit(False))
    rule = F.when(same_dst & same_port, 0).when(same_dst, 1).when(same_port, 2).otherwise(3)
    hits = J.range_join(e, f, ["src"], F.col("a"), F.col("b") + 86_400_000, "start_ms").select("event_id", "flow_id", rule.alias("rule"))
    best = hits.groupBy("event_id").agg(F.min("rule").alias("rule"))
    return hits.join(best, ["event_id", "rule"]).select("event_id", "flow_id", "rule")


@query("join_j5_uid_relation", "with l as (select distinct l_orderkey as uid, l_returnflag as label from lineitem) select o_custkey as relation, count(*) as uids, string_agg(distinct label, ',' order by label) as labels from orders join l on uid = o_orderkey group by 1")
def j5(spark, sf_dir):
    relations = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("relation")).agg(F.collect_list("o_orderkey").alias("uids"))
    labels = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_returnflag").alias("label")).distinct()
    hit = relations.select("relation", F.explode("uids").alias("uid")).join(labels, "uid")
    return hit.groupBy("relation").agg(F.count("*").alias("uids"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


_PARTS = "(select doc_id, sha256(text) as exact, case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 9 then 'validation' else 'test' end as split from documents)"


def _parts(spark, sf_dir):
    b = F.col("doc_id") % 10
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("exact"), F.when(b < 7, "train").when(b < 9, "validation").otherwise("test").alias("split"))


@query("join_j6_clean_exclusion", f"""with p as {_PARTS}, v as (select doc_id from p where split = 'validation' and exact in (select exact from p where split = 'train')),
t as (select doc_id, case when exact in (select exact from p where split = 'train') then 'train' else 'validation' end as cause from p where split = 'test' and (exact in (select exact from p where split = 'train') or exact in (select exact from p where split = 'validation' and doc_id not in (select doc_id from v))))
select doc_id, 'validation' as split, 'train' as cause from v union all select doc_id, 'test', cause from t""")
def j6(spark, sf_dir):
    """Two semi joins against distinct signatures; a validation row counts only if it stays itself."""
    p = _parts(spark, sf_dir)
    of = lambda s: p.where(F.col("split") == s)
    train = of("train").select("exact").distinct()
    validation = of("validation").join(train, "exact", "left_semi")
    rest = of("validation").join(train, "exact", "left_anti").select("exact").distinct()
    known = train.withColumn("cause", F.lit("train")).unionByName(rest.withColumn("cause", F.lit("validation")))
    test = of("test").join(known, "exact").groupBy("doc_id").agg(F.min("cause").alias("cause"))
    return validation.select("doc_id", F.lit("validation").alias("split"), F.lit("train").alias("cause")).union(test.select("doc_id", F.lit("test"), "cause"))


@query("join_j7_conflict_check", "with c as (select text from documents group by 1 having count(distinct source) > 1) select d.doc_id, d.source from documents d join c using (text)")
def j7(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.count_distinct("source").alias("k")).where("k > 1"), "h", "left_semi").select("doc_id", "source")


@query("join_j8_overlay", "select c_custkey, coalesce(case when o.k > 15 then 'HEAVY' end, c_mktsegment) as segment, c_nationkey from customer left join (select o_custkey, count(*) k from orders group by 1) o on o_custkey = c_custkey")
def j8(spark, sf_dir):
    heavy = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k")).where("k > 15").select("c_custkey", F.lit("HEAVY").alias("segment"))
    return J.overlay(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), "c_nationkey"), heavy, ["c_custkey"], ["segment"])


@query("join_j9_boundaries", f"with b as (select src % 4 as capture, min(start_ms) as lo, max(end_ms) as hi from {FLOWS_SQL} f group by 1) select f.flow_id, b.capture, f.start_ms - b.lo as since, b.hi - f.end_ms as until from {FLOWS_SQL} f join b on f.src % 4 = b.capture")
def j9(spark, sf_dir):
    """Four boundaries: as many rows as captures, so Catalyst may broadcast them within its size threshold."""
    f = flows(spark, sf_dir).withColumn("capture", F.col("src") % 4)
    b = f.groupBy("capture").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"))
    return f.join(b, "capture").select("flow_id", "capture", (F.col("start_ms") - F.col("lo")).alias("since"), (F.col("hi") - F.col("end_ms")).alias("until"))


@query("join_j10_coverage", "select count(*) filter (o_orderkey is null) as right_only, count(*) filter (l_orderkey is null) as left_only, count(*) filter (o_orderkey = l_orderkey) as matched from orders full join (select distinct l_orderkey from lineitem) l on o_orderkey = l_orderkey")
def j10(spark, sf_dir):
    a, b = read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return a.join(b, F.col("o_orderkey") == F.col("l_orderkey"), "full").agg(F.count_if(F.col("o_orderkey").isNull()).alias("right_only"), F.count_if(F.col("l_orderkey").isNull()).alias("left_only"), F.count_if(F.col("o_orderkey") == F.col("l_orderkey")).alias("matched"))


@query("join_j11_exact_clean", f"with p as {_PARTS} select doc_id, split from p where split <> 'train' and exact not in (select exact from p where split = 'train')")
def j11(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return p.where("split <> 'train'").join(p.where("split = 'train'").select("exact"), "exact", "left_anti").select("doc_id", "split")


@query("join_j12_semi", "select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def j12(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("join_j13_overlap", "select (select count(*) from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O')) as both_n, (select count(distinct o_custkey) from orders where o_orderstatus = 'F') as f_n, (select count(distinct o_custkey) from orders where o_orderstatus = 'O') as o_n")
def j13(spark, sf_dir):
    by = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "O").alias("o"))
    return by.agg(F.count_if(F.col("f") & F.col("o")).alias("both_n"), F.count_if("f").alias("f_n"), F.count_if("o").alias("o_n"))


@query("join_j15_pairing", "select a.conv_id, a.turn, length(a.text) as asked, length(b.text) as answered from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'")
def j15(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("asked"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("answered"))
    return a.join(b, ["conv_id", "turn"])


@query("join_j16_attribution", f"""with s as (select src, dport, count(distinct label) as k, max(label) as label, count(*) n from {FLOWS_SQL} f group by all)
select src, dport, case when n < 2 then 'insufficient' when k = 1 then 'pure' else 'mixed' end as outcome, case when k = 1 then label end as label from s""")
def j16(spark, sf_dir):
    s = flows(spark, sf_dir).groupBy("src", "dport").agg(F.count_distinct("label").alias("k"), F.max("label").alias("label"), F.count("*").alias("n"))
    return s.select("src", "dport", F.when(F.col("n") < 2, "insufficient").when(F.col("k") == 1, "pure").otherwise("mixed").alias("outcome"), F.when(F.col("k") == 1, F.col("label")).alias("label"))


@query("set_u1_union_all", "select c_nationkey as nation, 'c' as kind from customer union all select s_nationkey, 's' from supplier")
def u1(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind")).unionByName(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("s").alias("kind")))


@query("set_u2_distinct_keys", "select distinct l_partkey, l_suppkey from lineitem")
def u2(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("set_u3_intersect", "select c_nationkey as nation from customer intersect select s_nationkey from supplier")
def u3(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("set_u4_except", "select c_custkey as custkey from customer except select o_custkey from orders")
def u4(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")).exceptAll(read(spark, sf_dir, "orders").select("o_custkey").distinct()).distinct()


@query("set_u5_selection_overlap", f"select bytes > 1000 as a, packets > 8 as b, count(*) as n from {FLOWS_SQL} f group by all")
def u5(spark, sf_dir):
    return flows(spark, sf_dir).groupBy((F.col("bytes") > 1000).alias("a"), (F.col("packets") > 8).alias("b")).agg(F.count("*").alias("n"))
