"""Audits and cascades in full: identity dedup, gap profiles, shortcut tokens, application evidence, relation matching, quotas."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import context as C
from tidewell.operators import joins as J
from tidewell.operators import selection as P
from tidewell.operators import splits as G
from tidewell.plans.registry import query, read
from tidewell.sources.flows import FLOWS_SQL, flows

HOUR = 3_600_000


@query("src_s9_columns", "select l_returnflag, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity from lineitem group by 1")
def s9(spark, sf_dir):
    """Two of eleven columns are read."""
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("src_s10_by_ids", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P') and l_returnflag = 'N'")
def s10(spark, sf_dir):
    """A predicate that reaches the scan and a semi join by ids."""
    ids = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_partkey").join(ids, "l_orderkey", "left_semi")


@query("join_j14_strict_past", f"""with f as (select *, src % 4 as scope from {FLOWS_SQL} z) select t.flow_id, count(c.flow_id) as seen, cast(coalesce(sum(c.packets), 0) as bigint) as packets from f t left join f c on c.scope = t.scope and c.dport = t.dport and c.end_ms < t.start_ms and c.end_ms >= t.start_ms - {12 * HOUR} group by 1""")
def j14(spark, sf_dir):
    """A band self-join's counts without the join: what ended before a row began, of its scope and port."""
    f = flows(spark, sf_dir).withColumn("scope", F.col("src") % 4)
    c = C.past_context(f, ["scope", "dport"], "flow_id", "end_ms", "start_ms", {"": 12 * HOUR}, {"seen": F.lit(1), "packets": F.col("packets")}, {})
    return c.select("flow_id", F.col("seen_").alias("seen"), F.col("packets_").alias("packets"))


_A6 = """with r as (select l_orderkey || '-' || l_linenumber as id, l_returnflag || l_linestatus as label, l_partkey as record, l_suppkey, l_extendedprice as price, l_quantity::bigint as view, l_shipdate >= timestamp '1998-01-01' and l_shipdate < timestamp '1998-02-01' as edge from lineitem),
w as (select *, row_number() over (partition by id order by record, l_suppkey, price) as rn, (select 1) as one from r), g as (select id, count(distinct label) as k from r group by 1),
s as (select w.*, case when k > 1 then 'identity_label_conflict' when rn > 1 then 'identity_duplicate' when edge then 'split_boundary_or_gap' else 'retained' end as outcome from w join g using (id)),
v as (select view, count(*) as n, count(distinct label) as k from s where outcome = 'retained' group by 1)"""


@query("agg_a6_identity_audit", _A6 + """ select outcome as what, count(*) as rows, count(distinct id) as groups from s group by 1 union all select 'exact_view_collision', cast(coalesce(sum(n), 0) as bigint), count(*) from v where n > 1 union all select 'view_label_collision', cast(coalesce(sum(n), 0) as bigint), count(*) from v where k > 1""")
def a6(spark, sf_dir):
    """Conflicts, duplicates and edges go by identity; views that collide among what is left are counted, not removed."""
    w = Window.partitionBy("id")
    label = F.concat("l_returnflag", "l_linestatus")
    edge = (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1998-02-01").cast("timestamp"))
    r = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), label.alias("label"), F.col("l_partkey").alias("record"), "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("view"), edge.alias("edge"))
    r = r.withColumns({"rn": F.row_number().over(w.orderBy("record", "l_suppkey", "l_extendedprice")), "lo": F.min("label").over(w), "hi": F.max("label").over(w)})
    s = r.withColumn("what", F.when(F.col("lo") != F.col("hi"), "identity_label_conflict").when(F.col("rn") > 1, "identity_duplicate").when(F.col("edge"), "split_boundary_or_gap").otherwise("retained"))
    outcomes = s.groupBy("what").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("groups"))
    v = s.where("what = 'retained'").groupBy("view").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k"))
    many, mixed = F.col("n") > 1, F.col("k") > 1
    cell = lambda name, c: F.struct(F.lit(name).alias("what"), F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias("rows"), F.count_if(c).alias("groups"))
    seen = v.agg(cell("exact_view_collision", many).alias("a"), cell("view_label_collision", mixed).alias("b")).select(F.explode(F.array("a", "b")).alias("x")).select("x.*")
    return outcomes.union(seen)


_KEYS = {"directed": "src % 50 || '>' || dst % 20", "unordered": "least(src % 50, dst % 20) || '-' || greatest(src % 50, dst % 20)", "source": "cast(src % 50 as {text})"}
_QS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
_A13 = " union all ".join(f"select '{n}' as keying, {k.format(text='varchar')} as k, start_ms, flow_id from {FLOWS_SQL} f" for n, k in _KEYS.items())


@query("agg_a13_gap_profiles", f"""with f as ({_A13}), g as (select keying, k, flow_id, start_ms - lag(start_ms) over (partition by keying, k order by flow_id) as gap from f), p as (select *, row_number() over (partition by keying order by flow_id) as rn from g where gap > 0), s as (select keying, gap from p where rn % 10 = 0),
q as (select keying, count(*) as sampled, {', '.join(f'cast(floor(quantile_cont(gap, {v})) as bigint) as {n}' for n, v in _QS.items())}, max(gap) as most from s group by 1),
c as (select keying, count(distinct k) as keys, count(gap) as gaps, count(*) filter (gap > 0) as positive, count(*) filter (gap < 0) as negative from g group by 1) select * from c join q using (keying)""")
def a13(spark, sf_dir):
    """Three keyings at once; every tenth positive gap in order of rows, by running totals; quantiles from counts by range."""
    keyed = F.array(*[F.struct(F.lit(n).alias("keying"), F.expr(k.format(text="string")).alias("k")) for n, k in _KEYS.items()])
    f = flows(spark, sf_dir).select("flow_id", "start_ms", F.explode(keyed).alias("x")).select("flow_id", "start_ms", "x.*")
    g = f.withColumn("gap", F.col("start_ms") - F.lag("start_ms").over(Window.partitionBy("keying", "k").orderBy("flow_id")))
    positive = g.where("gap > 0").withColumn("one", F.lit(1))
    s = G.running_by_range(positive, "flow_id", {"before": "one"}, groups=["keying"]).where((F.col("before") + 1) % 10 == 0)
    q = G.quantiles(s, "gap", _QS, ["keying"]).withColumnRenamed("n", "sampled")
    q = q.select("keying", "sampled", *[F.floor(n).alias(n) for n in _QS]).join(s.groupBy("keying").agg(F.max("gap").alias("most")), "keying")
    c = g.groupBy("keying").agg(F.count_distinct("k").alias("keys"), F.count("gap").alias("gaps"), F.count_if(F.col("gap") > 0).alias("positive"), F.count_if(F.col("gap") < 0).alias("negative"))
    return c.join(q, "keying")


@query("agg_a19_token_floors", r"""with d as (select doc_id, lang, text from documents where lang is not null), n as (select lang, count(*) as n from d group by 1), t as (select distinct doc_id, lang, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.-]{3,}'))) as token from d),
c as (select token, min(lang) as lang, count(distinct lang) as k, count(*) as support from t where token not in ('select', 'union', 'http', 'login') group by 1) select token, lang, support, round(support / n, 9) as share from c join n using (lang) where k = 1 and support >= 10 and support >= 0.02 * n""")
def a19(spark, sf_dir):
    """Tokens of one class alone, with floors on documents and on the share of the class."""
    d = read(spark, sf_dir, "documents").where("lang is not null")
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9_.-]{3,}"), 0), lambda x: F.lower(x)))
    t = d.select("lang", F.explode(words).alias("token")).where(~F.col("token").isin("select", "union", "http", "login"))
    c = t.groupBy("token").agg(F.min("lang").alias("lang"), F.max("lang").alias("high"), F.count("*").alias("support")).where("lang = high and support >= 10")
    n = d.groupBy("lang").agg(F.count("*").alias("n"))
    return c.join(n, "lang").where(F.col("support") >= F.lit(0.02).cast("decimal(4,2)") * F.col("n")).select("token", "lang", "support", F.round(F.col("support") / F.col("n"), 9).alias("share"))


@query("agg_a21_lengths", """with l as (select n_chars, row_number() over (order by n_chars) rn, count(*) over () n from documents) select max(n) as n, round(avg(n_chars), 6) as mean, """ + ", ".join(f"max(n_chars) filter (rn = greatest(1, ceil({q} * n))) as p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + ", max(n_chars) as most from l")
def a21(spark, sf_dir):
    by = read(spark, sf_dir, "documents").groupBy("n_chars").agg(F.count("*").alias("c"))
    up = G.running_by_range(by, "n_chars", {"under": "c"}).crossJoin(F.broadcast(by.agg(F.sum("c").alias("n"))))
    at = lambda q: F.min(F.when(F.col("under") + F.col("c") >= F.greatest(F.lit(1), F.ceil(F.lit(q).cast("decimal(4,2)") * F.col("n"))), F.col("n_chars")))
    return up.agg(F.max("n").alias("n"), F.round(F.sum(F.col("n_chars") * F.col("c")) / F.max("n"), 6).alias("mean"), *[at(q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)], F.max("n_chars").alias("most"))


@query("agg_a24_application_evidence", f"""with r as (select *, row_number() over (partition by src order by start_ms, flow_id) as rn, count(*) over (partition by src) as every from {FLOWS_SQL} f), v as (select src, every > 24 as truncated, case when dport % 3 = 0 then upper(label) end as method, case when dport % 4 = 0 then 200 + dst end as status from r where rn <= 24),
g as (select src, bool_or(truncated) as truncated, count(method) as requests, count(status) as responses, array_to_string(list_sort(list(distinct method)), ' ') as methods, array_to_string(list_slice(list_sort(list(distinct status)), 1, 24), ' ') as statuses, coalesce(bool_or(status in (201, 203)), false) as auth from v group by 1)
select *, case when requests > 0 and responses > 0 then 'BIDIRECTIONAL' when requests > 0 then 'REQUEST_ONLY' when responses > 0 then 'RESPONSE_ONLY' else 'NONE' end as structure from g""")
def a24(spark, sf_dir):
    """The first 24 observations of each key, their distinct values, and how requests and responses go together."""
    w = Window.partitionBy("src")
    r = flows(spark, sf_dir).withColumns({"rn": F.row_number().over(w.orderBy("start_ms", "flow_id")), "every": F.count("*").over(w)}).where("rn <= 24")
    v = r.select("src", (F.col("every") > 24).alias("truncated"), F.when(F.col("dport") % 3 == 0, F.upper("label")).alias("method"), F.when(F.col("dport") % 4 == 0, 200 + F.col("dst")).alias("status"))
    text = lambda c: F.when(F.count(c) > 0, F.array_join(G.first_sorted(F.collect_set(c), 24), " "))  # noqa: E731 (null if there is none)
    g = v.groupBy("src").agg(F.bool_or("truncated").alias("truncated"), F.count("method").alias("requests"), F.count("status").alias("responses"), text("method").alias("methods"), text("status").alias("statuses"), F.coalesce(F.bool_or(F.col("status").isin(201, 203)), F.lit(False)).alias("auth"))
    some = F.col("requests") > 0, F.col("responses") > 0
    return g.withColumn("structure", F.when(some[0] & some[1], "BIDIRECTIONAL").when(some[0], "REQUEST_ONLY").when(some[1], "RESPONSE_ONLY").otherwise("NONE"))


_REL = f"""(select 'r' || flow_id as id, start_ms - 1000 as a, end_ms + 14400000 as b, src % 5 as scope, case when flow_id % 120 = 0 then null else dst % 20 end as x, dport as y, case when flow_id % 90 = 0 then null else packets % 4 end as px, case when flow_id % 150 = 0 then null else bytes % 3 end as py from {FLOWS_SQL} f where flow_id % 30 = 0)"""


@query("join_j4_full_cascade", f"""with f as (select flow_id, start_ms, src % 5 as scope, dst % 20 as s, dport as t, packets % 4 as ps, bytes % 3 as pt from {FLOWS_SQL} z), e as {_REL},
m as (select e.id, f.flow_id, e.x is null as wild, e.px is null or e.py is null as open, f.flow_id is not null as hit, e.x = s and e.y = t and e.px = ps and e.py = pt as direct, e.x = t and e.y = s and e.px = pt and e.py = ps as back,
 (e.x is null or e.x = s) and e.y = t as ends, (e.x is null or e.x = t) and e.y = s as ends_back, (e.px is null or e.px = ps) and (e.py is null or e.py = pt) as ports, (e.px is null or e.px = pt) and (e.py is null or e.py = ps) as ports_back from e left join f on f.scope = e.scope and f.start_ms between e.a and e.b),
g as (select id, bool_or(wild) as wild, bool_or(open) as open, count(*) filter (hit) as in_time, count(*) filter (direct) as direct, count(*) filter (back) as back, count(*) filter (ends or ends_back) as ends, count(*) filter ((ends and ports) or (ends_back and ports_back)) as fits, bool_or(ends and ports) as d, bool_or(ends_back and ports_back) as r from m group by 1)
select id, in_time, ends, fits, case when direct > 0 then 'R0' when back > 0 then 'R1' when fits > 0 and wild and open then 'R3+R4' when fits > 0 and wild then 'R3' when fits > 0 and open then 'R4' when fits > 0 then 'R2' else 'R5' end as rule, case when in_time = 0 then 'no_flow_in_time' when ends = 0 then 'endpoint_mismatch' when fits = 0 then 'port_mismatch' else '' end as reason,
 case when direct + back + fits = 0 then '' when coalesce(d, false) and coalesce(r, false) then 'both' when coalesce(d, false) then 'direct' else 'reverse' end as direction, not (direct = 1) as review from g""")
def j4(spark, sf_dir):
    """Relations and the flows of their closed time span: rules from exact to open, direction, and why nothing fits."""
    f = flows(spark, sf_dir)
    rows = f.select("flow_id", "start_ms", (F.col("src") % 5).alias("scope"), (F.col("dst") % 20).alias("s"), F.col("dport").cast("long").alias("t"), (F.col("packets") % 4).alias("ps"), (F.col("bytes") % 3).alias("pt"))
    some = lambda n, c: F.when(F.col("flow_id") % n != 0, c)
    e = f.where("flow_id % 30 = 0").select(F.concat(F.lit("r"), "flow_id").alias("id"), (F.col("start_ms") - 1000).alias("a"), (F.col("end_ms") + 14_400_000).alias("b"), (F.col("src") % 5).alias("scope"), some(120, F.col("dst") % 20).alias("x"), F.col("dport").cast("long").alias("y"), some(90, F.col("packets") % 4).alias("px"), some(150, F.col("bytes") % 3).alias("py"))
    return J.relation_cascade(e, rows, 14_400_000)


@query("smp_z20_shortfall", f"""with u as (select label, least(9, bytes // 1000) as bin, count(*) as n from {FLOWS_SQL} f where flow_id % 11 <> 0 group by 1, 2) select label, cast(sum(least(n, 30)) as bigint) as found, greatest(0, 200 - cast(sum(least(n, 30)) as bigint)) as lacking from u group by 1""")
def z20(spark, sf_dir):
    """What balanced cells can give a class, and what they lack of its quota: the check that precedes a draw."""
    f = flows(spark, sf_dir).where("flow_id % 11 <> 0").withColumn("bin", F.least(F.lit(9), F.floor(F.col("bytes") / 1000)))
    n = f.groupBy("label", "bin").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum(F.least("n", F.lit(30))).alias("found"))
    return n.withColumn("lacking", F.greatest(F.lit(0), 200 - F.col("found")))


@query("evl_e6_weighted_recall", f"""select round(sum(packets) filter (bytes >= 300 and label = 'error') / sum(packets) filter (label = 'error'), 9) as recall from {FLOWS_SQL} f""")
def e6(spark, sf_dir):
    unknown, w = F.col("label") == "error", F.col("packets")
    return flows(spark, sf_dir).agg(F.round(F.sum(F.when(unknown & (F.col("bytes") >= 300), w)) / F.sum(F.when(unknown, w)), 9).alias("recall"))


@query("agg_a2_invariants", f"""with f as (select *, bytes // 7 as lo, bytes % 900 as hi, packets % 5 as g0, packets % 7 as g1, packets % 11 as g2 from {FLOWS_SQL} z) select count(*) filter (end_ms < start_ms) as reversed, count(*) filter (abs((end_ms - start_ms) - bytes * 10) > 1) as duration, count(*) filter (lo > hi) as low_high, count(*) filter (g0 > g1) as gap_low, count(*) filter (g1 > g2) as gap_high, count(*) filter ((label = 'error') <> (packets > 8)) as labels from f""")
def a2(spark, sf_dir):
    """Each rule takes part if its columns are there."""
    f = flows(spark, sf_dir).selectExpr("*", "floor(bytes / 7) as lo", "bytes % 900 as hi", "packets % 5 as g0", "packets % 7 as g1", "packets % 11 as g2")
    rules = {"reversed": "end_ms < start_ms", "duration": "abs((end_ms - start_ms) - bytes * 10) > 1", "low_high": "lo > hi", "gap_low": "g0 > g1", "gap_high": "g1 > g2", "labels": "(label = 'error') <> (packets > 8)"}
    needs = {"low_high": {"lo", "hi"}, "gap_low": {"g0", "g1"}, "gap_high": {"g1", "g2"}}
    there = {n: r for n, r in rules.items() if needs.get(n, set()) <= set(f.columns)}
    return f.agg(*[F.count_if(F.expr(r)).alias(n) for n, r in there.items()])


@query("win_w13_smallest_supporting", f"""with f as (select *, src % 4 as scope from {FLOWS_SQL} z), c as (select t.flow_id, {', '.join(f"count(distinct c.dport) filter (c.start_ms >= t.start_ms - {h * HOUR}) as p{h}, count(c.flow_id) filter (c.start_ms >= t.start_ms - {h * HOUR}) as n{h}" for h in (1, 6, 24))} from f t left join f c on c.src = t.src and c.start_ms < t.start_ms and c.start_ms >= t.start_ms - {24 * HOUR} group by 1)
select flow_id, case when n1 >= 2 and p1 >= 2 then 1 when n6 >= 2 and p6 >= 2 then 6 when n24 >= 2 and p24 >= 2 then 24 end as strongest, case when n24 >= 1 then 24 when n6 >= 1 then 6 when n1 >= 1 then 1 end as widest from c""")
def w13(spark, sf_dir):
    """The smallest horizon whose context supports the pattern, and the widest that has any."""
    c = C.past_context(flows(spark, sf_dir), ["src"], "flow_id", "start_ms", "start_ms", {str(h): h * HOUR for h in (1, 6, 24)}, {"n": F.lit(1)}, {"p": F.col("dport")})
    holds = lambda h: (F.col(f"n_{h}") >= 2) & (F.col(f"p_{h}") >= 2)
    return c.select("flow_id", F.coalesce(*[F.when(holds(h), h) for h in (1, 6, 24)]).alias("strongest"), F.coalesce(*[F.when(F.col(f"n_{h}") >= 1, h) for h in (24, 6, 1)]).alias("widest"))


@query("smp_z24_ordinals", "with r as (select doc_id, sha256(text) as h, n_chars, row_number() over (partition by sha256(text) order by n_chars, doc_id) as rn, count(*) over (partition by sha256(text)) as copies from documents) select doc_id, h, copies from r where rn = 1 and copies > 1")
def z24(spark, sf_dir):
    """Of each group of equal texts the first, with how many there are; groups of one are none."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("h"))
    n = d.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1")
    return P.representative(d.join(n, "h"), ["h"], ["n_chars", "doc_id"]).select("doc_id", "h", "copies")
