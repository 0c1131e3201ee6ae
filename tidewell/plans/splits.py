"""Queries of the splits and samplers that look at groups, quotas or budgets."""

from pyspark.sql import functions as F

from tidewell.operators import splits as P
from tidewell.plans.registry import query, read
from tidewell.sources.flows import FLOWS_SQL, flows


@query("spl_z7_boundary_search")
def z7(spark, sf_dir):
    """No SQL: a ranking of 500 anchors and a second one of the best; held against a plain loop in the tests."""
    f = flows(spark, sf_dir).select((F.col("src") % 64).alias("capture"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.concat_ws(":", "label", "bytes").alias("exact"), F.concat_ws(":", "label", "packets").alias("near"))
    return P.boundaries(f, "capture", 5000.0)


@query("spl_z11_balanced_bins")
def z11(spark, sf_dir):
    """No SQL: each group's bin depends on all before it; held against a plain loop in the tests."""
    f = flows(spark, sf_dir).withColumn("grp", F.concat_ws("-", F.col("src") % 500, F.floor(F.col("start_ms") / 86_400_000)))
    return P.balanced_bins(f.withColumn("block", F.floor(F.col("start_ms") / 864_000_000)), ["label", "block"], "grp", "start_ms", "flow_id")


@query("spl_z14_early_groups", f"""with c as (select label, src % 50 as grp, count(*) as n, sha256('s7' || (src % 50)) as h from {FLOWS_SQL} f group by all),
w as (select *, coalesce(sum(n) over (partition by label order by h rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over (partition by label) as total from c)
select label, grp, before < round_even(total * 0.1000::decimal(10,4), 0) as early from w""")
def z14(spark, sf_dir):
    return P.early_groups(flows(spark, sf_dir).withColumn("grp", F.col("src") % 50), "label", "grp", "s7")


@query("spl_z15_group_search")
def z15(spark, sf_dir):
    """No SQL: a random search over 25 groups; the shortfall and the parts are checked in the tests."""
    pairs = read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct().collect()
    members: dict[str, set[str]] = {}
    for r in pairs:
        members.setdefault(f"n{r['c_nationkey']:02d}", set()).add(r["c_mktsegment"])
    n = len(members)
    lack, parts = P.group_split_search(members, sorted(set().union(*members.values())), (n - 2 * (n // 5), n // 5, n // 5), (3, 1, 1), 7, 2000)
    return spark.createDataFrame([(g, p, lack) for p, names in parts.items() for g in names], "grp string, part int, lack int")


@query("smp_z17_support_query")
def z17(spark, sf_dir):
    """No SQL: the choice is greedy; the tests hold its rules."""
    f = flows(spark, sf_dir).select("flow_id", "label", F.concat_ws(":", "src", "dst", "dport").alias("exact"), F.concat_ws(":", F.least("src", "dst"), F.greatest("src", "dst")).alias("reverse"), F.concat_ws(":", F.col("src") % 40, "dport").alias("near"))
    return P.support_and_query(f, "label", "flow_id", ["exact", "reverse", "near"], "s3", 5, 50)


@query("smp_z21_round_robin", f"""with r as (select flow_id, label, dport % 3 as stage, packets > 8 as flag, row_number() over (partition by label, dport % 3, packets > 8 order by sha256('rl' || flow_id)) as turn from {FLOWS_SQL} f)
select flow_id from r order by turn, label, stage, flag limit 400""")
def z21(spark, sf_dir):
    f = flows(spark, sf_dir).select("flow_id", "label", (F.col("dport") % 3).alias("stage"), (F.col("packets") > 8).alias("flag"))
    return P.round_robin(f, ["label", "stage", "flag"], [F.sha2(F.concat(F.lit("rl"), F.col("flow_id").cast("string")), 256)], 400).select("flow_id")


@query("smp_z25_quotas", f"""with k as (select flow_id, label, case when dport < 3 then 'enough' when dport < 7 then 'none_next' else 'open' end as kind, sha256('q' || flow_id) as h from {FLOWS_SQL} f),
r as (select *, row_number() over (partition by label, kind order by h) as n from k),
s as (select *, case when kind = 'enough' and n <= 5 then 0 when kind = 'none_next' and n <= 10 then 0 when kind = 'open' then 1 when kind = 'none_next' then 2 end as step from r),
f as (select *, row_number() over (partition by label order by step, n, kind) as place from s where step is not null) select flow_id, label, kind from f where place <= 30""")
def z25(spark, sf_dir):
    d = F.col("dport")
    f = flows(spark, sf_dir).select("flow_id", "label", F.when(d < 3, "enough").when(d < 7, "none_next").otherwise("open").alias("kind"))
    return P.quotas(f, "label", "kind", F.sha2(F.concat(F.lit("q"), F.col("flow_id").cast("string")), 256), 30, {"enough": 5, "none_next": 10}, ["open", "none_next"])


_UTILITY = "bytes % 37 - 18 as u_t, packets * 3 - 25 as u_r, dport * 4 - 24 as u_tr"


@query("srt_t5_budget", f"""with recursive_free as (select flow_id, {_UTILITY} from {FLOWS_SQL} f), b as (select *, greatest(u_t, u_r, u_tr) as u from recursive_free), w as (select *, case when u_t = u then 'T' when u_r = u then 'R' else 'TR' end as wish from b where u > 0),
c as (select *, sum(case when wish = 'TR' then 2 else 1 end) over (order by u desc, flow_id rows unbounded preceding) as spent from w),
i as (select * from c where spent <= 801), rest as (select *, case when wish <> 'TR' then wish when u_t > 0 then 'T' when u_r > 0 then 'R' end as single from c where spent > 801)
select flow_id, wish as action from i union all (select flow_id, single from rest where single is not null and (select coalesce(max(spent), 0) from i) < 801 order by u desc, flow_id limit 1)""")
def t5(spark, sf_dir):
    return P.typed_actions(flows(spark, sf_dir).selectExpr("flow_id", *_UTILITY.split(", ")), 801, "flow_id")


@query("srt_t6_oracle_actions", f"""with p as (select flow_id, dport % 2 = 0 as t, dport % 3 = 0 as r, dport % 5 = 0 as tr from {FLOWS_SQL} f where packets > 4), s as (select flow_id, case when tr then 3 when t then 2 else 1 end as score, case when t or r then 1 else 2 end as cost,
 case when t then 'T' when r then 'R' else 'TR' end as action from p where t or r or tr), c as (select *, sum(cost) over (order by score desc, flow_id rows unbounded preceding) as spent from s)
select flow_id, action from c where spent <= 600""")
def t6(spark, sf_dir):
    """Rows that an action helps, those that TR helps first; each takes the first of T, R, TR that helps it. The budget is even and no row is skipped before it ends."""
    d = F.col("dport")
    t, r, tr = d % 2 == 0, d % 3 == 0, d % 5 == 0
    p = flows(spark, sf_dir).where("packets > 4").select("flow_id", F.when(tr, 3).when(t, 2).when(r, 1).alias("score"), F.when(t, "T").when(r, "R").when(tr, "TR").alias("action")).where("score is not null")
    held = P.running_by_range(p.withColumn("cost", F.when(F.col("action") == "TR", 2).otherwise(1)), "score", {"before": "cost"}, descending=True, tie="flow_id")
    return held.where(F.col("before") + F.col("cost") <= 600).select("flow_id", "action")


@query("srt_t7_retrieval_topk", """with s as (select item_id, length(text)::bigint % 97 as score from benchmark) select item_id, score from s order by score desc, item_id limit 20""")
def t7(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", (F.length("text") % 97).cast("long").alias("score")).orderBy(F.desc("score"), "item_id").limit(20)


@query("srt_t8_bounded_list", f"select src, array_to_string(list_slice(list_sort(list(distinct dst)), 1, 24), ' ') as dsts from {FLOWS_SQL} f group by 1")
def t8(spark, sf_dir):
    return flows(spark, sf_dir).groupBy("src").agg(F.array_join(P.first_sorted(F.collect_set("dst"), 24), " ").alias("dsts"))
