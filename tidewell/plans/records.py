"""Queries of the record functions and of the joins, aggregations, sessions and samplers in their full form."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import records as X
from tidewell.functions import validation as V
from tidewell.operators import joins as J
from tidewell.operators import selection as P
from tidewell.operators import sessions as S
from tidewell.operators import splits as G
from tidewell.plans.registry import query, read
from tidewell.sources import scans
from tidewell.sources.flows import FLOWS_SQL, flows


@query("fun_f1_numbers", f"""select flow_id, case flow_id % 6 when 0 then 7.0 when 1 then bytes + 0.5::double else 7.0 end as f, case flow_id % 6 when 1 then bytes when 4 then -3 else 0 end as i, case flow_id % 6 when 2 then 18 when 3 then dport when 4 then -3 else 0 end as flags from {FLOWS_SQL} f""")
def f1(spark, sf_dir):
    t = F.expr("case flow_id % 6 when 0 then '-' when 1 then bytes || '.5' when 2 then '0x12,3' when 3 then dport || ',9' when 4 then '-3' else 'x' end")
    rows = flows(spark, sf_dir).withColumn("t", t)
    number = F.when(F.col("flow_id") % 6 == 4, F.lit("nan")).otherwise(F.col("t"))
    return rows.select("flow_id", X.finite_number(number, 7.0).alias("f"), X.whole_part(F.col("t")).alias("i"), F.when(F.col("flow_id") % 6 != 1, scans.whole_number(scans.first_value(F.col("t")))).otherwise(0).alias("flags"))


_SERVICE_SQL = ", ".join(f"({p}, '{s}')" for p, s in X.PORT_SERVICES.items())


@query("fun_f4_service_category", f"""with m(port, name) as (values {_SERVICE_SQL}), f as (select flow_id, case when flow_id % 5 = 0 then 0 else dst * 20 end as sp, case when flow_id % 10 = 0 then 0 else dport * 700 + 22 * (dport % 2) end as dp, case when flow_id % 7 = 0 then 'h T!tp' when flow_id % 7 = 1 then '-' else '' end as given from {FLOWS_SQL} z)
select flow_id, case when given = 'h T!tp' then 'HTTP' when a.name is not null then a.name when b.name is not null then b.name when greatest(sp, dp) = 0 then 'TCP' when (case when least(sp, dp) = 0 then greatest(sp, dp) else least(sp, dp) end) < 1024 then 'OTHER_SYSTEM'
 when (case when least(sp, dp) = 0 then greatest(sp, dp) else least(sp, dp) end) < 49152 then 'OTHER_REGISTERED' else 'EPHEMERAL' end as category, case when given = 'h T!tp' then 'supplied' when coalesce(a.name, b.name) is not null then 'known_port' when greatest(sp, dp) = 0 then 'protocol' else 'port_range' end as source
 from f left join m a on a.port = least(sp, dp) left join m b on b.port = greatest(sp, dp)""")
def f4(spark, sf_dir):
    f = flows(spark, sf_dir).selectExpr("flow_id", "case when flow_id % 5 = 0 then 0 else dst * 20 end as sp", "case when flow_id % 10 = 0 then 0 else dport * 700 + 22 * (dport % 2) end as dp", "case when flow_id % 7 = 0 then 'h T!tp' when flow_id % 7 = 1 then '-' else '' end as given")
    return f.select("flow_id", X.service(F.lit("TCP"), F.col("sp"), F.col("dp"), F.col("given")).alias("s")).select("flow_id", "s.*")


@query("fun_f10_observation", f"""select flow_id, case when flow_id % 5 = 0 then 'http' when flow_id % 5 = 1 then 'dns' when flow_id % 5 = 2 then 'tls' when flow_id % 5 = 3 then 'modbus' end as kind,
 case when flow_id % 5 = 0 then 'GET' when flow_id % 5 = 1 then '<HOST>' when flow_id % 5 = 2 then cast(dport as varchar) when flow_id % 5 = 3 then null end as detail, case when flow_id % 5 = 0 then 200 + dport when flow_id % 5 = 1 then dport end as number from {FLOWS_SQL} f""")
def f10(spark, sf_dir):
    of = lambda k, sql: F.expr(f"if(flow_id % 5 = {k}, {sql}, null)").cast("string")
    frame = {"protocols": of(3, "'eth:ip:MODBUS'"), "method": of(0, "'get'"), "status": of(0, "200 + dport || 'x'"), "query_name": of(1, "'a.b'"), "query_shape": of(1, "'<HOST>'"), "query_type": of(1, "dport"), "tls_type": of(2, "dport"), "function": of(9, "'1'")}
    return flows(spark, sf_dir).select("flow_id", X.observation(frame).alias("o")).select("flow_id", "o.kind", "o.detail", "o.number")


_COUNTERS = {"requests": "dport % 5", "responses": "dport % 3", "denied": "dport = 4", "writes": "dport = 6", "tls": "dport = 7", "sent_packets": "packets", "got_packets": "packets % 4", "synack": "packets % 2", "syn": "packets % 3", "rst": "packets = 9", "sent_payload": "bytes * 10", "got_payload": "bytes % 700 * 9", "packets": "packets", "bytes": "bytes", "duration": "(end_ms - start_ms) / 1000"}
_SIGNALS = {
    "authentication_failure": "dport = 4", "bidirectional_exchange": "packets > 0 and packets % 4 > 0", "client_payload_asymmetry": "bytes * 10 >= 4 * greatest(1, bytes % 700 * 9)", "encrypted_application": "dport = 7",
    "established_exchange": "packets % 2 > 0 or (bytes > 0 and bytes % 700 > 0) or (dport % 5 > 0 and dport % 3 > 0)", "high_syn_ratio": "packets % 3 >= 0.75 * packets", "http_activity": "dport % 5 > 0", "incomplete_handshake": "packets % 3 > 0 and packets % 2 = 0",
    "large_client_body": "bytes * 10 >= 65536", "repeated_request_in_session": "dport % 5 >= 4", "request_response_exchange": "dport % 5 > 0 and dport % 3 > 0", "reset_observed": "packets = 9", "short_session": "packets <= 4 and (end_ms - start_ms) / 1000.0::double <= 2", "small_flow": "packets <= 12 and bytes <= 4096", "write_method": "dport = 6",
}


@query("fun_f11_session_signals", "select flow_id, array_to_string(list_filter([" + ", ".join(f"case when {w} then '{n}' end" for n, w in _SIGNALS.items()) + f"], lambda x: x is not null), ' ') as signals from {FLOWS_SQL} f")
def f11(spark, sf_dir):
    c = {n: F.expr(f"cast({e} as double)") for n, e in _COUNTERS.items()}
    return flows(spark, sf_dir).select("flow_id", F.array_join(X.session_signals(c), " ").alias("signals"))


@query("fun_f12_class_rules", f"""select flow_id, case label when 'click' then dport % 2 = 0 or dport % 3 = 0 when 'error' then dport % 2 = 0 and packets > 8 end as relevant, case when dport = 0 then 'NONE' when dport % 2 = 0 and packets <= 8 then 'SESSIONIZATION_LOSS' when dport % 2 = 1 then 'NETWORK_OBSERVABILITY_LIMITED' when dport = 4 then 'EVIDENCE_SELECTION_LOSS'
 when dport = 6 then 'TEMPORAL_FEATURE_GAP' when dport = 8 then 'RELATION_FEATURE_GAP' else 'AMBIGUOUS' end as mode from {FLOWS_SQL} f""")
def f12(spark, sf_dir):
    f, d = flows(spark, sf_dir), F.col("dport")
    label = F.when(F.col("label") == "click", "SQL_injection").when(F.col("label") == "error", "Backdoor")
    some = lambda when, *names: F.when(when, F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    sets = {"p": some((d % 2 == 0) & (F.col("label") == "click"), "sql_expression"), "a": some(d % 3 == 0, "sql_expression", "http"), "t": some(d % 2 == 0, "periodic_service_pattern"), "r": none, "s": some(F.col("packets") > 8, "bidirectional_exchange")}
    c = {"supported": d == 0, "raw_signal": d % 2 == 0, "session_keeps": F.col("packets") > 8, "payload_available": d == 4, "payload_visible": F.lit(False), "application_available": F.lit(False), "application_visible": F.lit(True), "temporal_gap": d == 6, "relation_gap": d == 8}
    return f.select("flow_id", X.class_relevant(label, sets).alias("relevant"), X.failure_mode(c).alias("mode"))


@query("fun_f13_tiers", f"""select flow_id, case when packets <= 8 then 'first_8' when packets <= 16 then 'packet_9_16' else 'after_16' end as bucket, case when dport >= 7 then 'HIGH' when dport >= 3 then 'MEDIUM' else 'LOW' end as risk, case when bytes < 400 then 'LOW' when bytes < 700 then 'MID' else 'HIGH' end as bin,
 case when bytes >= 5000 then 3 when bytes >= 1000 then 2 when bytes >= 1 then 1 else 0 end as tier from {FLOWS_SQL} f""")
def f13(spark, sf_dir):
    b = F.col("bytes")
    return flows(spark, sf_dir).select("flow_id", X.tier(F.col("packets"), [9, 17], ["first_8", "packet_9_16", "after_16"]).alias("bucket"), X.tier(F.col("dport"), [3, 7], ["LOW", "MEDIUM", "HIGH"]).alias("risk"), X.tier(b, [400, 700], ["LOW", "MID", "HIGH"]).alias("bin"), X.tier(b, [1, 1000, 5000], ["0", "1", "2", "3"]).cast("int").alias("tier"))


@query("fun_f14_scaled", f"""with t as (select avg(bytes) m, stddev_pop(bytes) s from {FLOWS_SQL} f where flow_id % 2 = 0) select flow_id, round(least(2, greatest(-2, (bytes - m) / s)), 6) as z, round(case when flow_id % 3 = 0 then ln(1 + 1e15::double) when flow_id % 3 = 1 then 0 else -ln(1 + bytes) end, 6) as l from {FLOWS_SQL} g, t""")
def f14(spark, sf_dir):
    """Fitted on one half of the rows, applied to all."""
    f = flows(spark, sf_dir)
    fitted = X.fit_scale(f.where("flow_id % 2 = 0"), ["bytes"])
    odd = F.when(F.col("flow_id") % 3 == 0, F.lit(float("inf"))).when(F.col("flow_id") % 3 == 1, F.lit(float("nan"))).otherwise(-F.col("bytes"))
    return f.select("flow_id", F.round(X.scaled("bytes", fitted, 2.0), 6).alias("z"), F.round(X.clamped_log(odd), 6).alias("l"))


_P3 = "[(1 + dport) / (20.0::double + dport + packets), (1 + packets) / (20.0::double + dport + packets), 18.0::double / (20.0::double + dport + packets)]"


@query("fun_f15_probabilities", f"""with p as (select flow_id, {_P3} as p from {FLOWS_SQL} f) select flow_id, round(-(p[1] * ln(p[1]) + p[2] * ln(p[2]) + p[3] * ln(p[3])) / ln(3), 6) as entropy, round(list_sort(p, 'DESC')[1], 6) as confidence, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 6) as margin, list_position(p, list_max(p)) - 1 as best from p""")
def f15(spark, sf_dir):
    p = F.expr("array(" + _P3.strip("[]").replace("::double", "D") + ")")
    return flows(spark, sf_dir).withColumn("p", p).select("flow_id", F.round(X.entropy(F.col("p")), 6).alias("entropy"), F.round(F.array_max("p"), 6).alias("confidence"), F.round(X.margin(F.col("p")), 6).alias("margin"), X.first_best(F.col("p")).alias("best"))


@query("fun_f16_trajectory", f"""with p as (select flow_id, {_P3} as p, list_reverse({_P3}) as q, flow_id % 4 as act from {FLOWS_SQL} f), x as (select *, list_position(p, list_max(p)) as i, list_position(q, list_max(q)) as j, list_sort(p, 'DESC') as ps, list_sort(q, 'DESC') as qs from p)
select flow_id, 19 as n, round(qs[1], 6) as confidence, round(qs[1] - qs[2], 6) as margin, (act = 1)::int as is_t, round(ps[1], 6) as before, (i <> j)::int as moved, round(p[j], 6) as was, round(q[i], 6) as becomes, round(q[j] - q[i], 6) as gap from x""")
def f16(spark, sf_dir):
    p = F.expr("array(" + _P3.strip("[]").replace("::double", "D") + ")")
    action = F.expr("element_at(array('NONE', 'T', 'R', 'TR'), cast(flow_id % 4 + 1 as int))")
    v = flows(spark, sf_dir).select("flow_id", p.alias("p"), action.alias("a")).select("flow_id", X.trajectory(F.col("p"), F.reverse("p"), F.col("a"), ["NONE", "T", "R", "TR"]).alias("v"))
    at = lambda k, n: F.round(F.get("v", F.lit(k)), 6).alias(n)
    return v.select("flow_id", F.size("v").alias("n"), at(0, "confidence"), at(1, "margin"), F.get("v", F.lit(4)).cast("int").alias("is_t"), at(7, "before"), F.get("v", F.lit(13)).cast("int").alias("moved"), at(14, "was"), at(15, "becomes"), at(18, "gap"))


@query("fun_f17_direction", f"select flow_id, round(case when bytes > 0 then abs(bytes // 3 - (bytes - bytes // 3)) / bytes else 0 end, 9) as asymmetry, round(case when bytes > 0 then (bytes // 3) / bytes else 0 end, 9) as sent_share from {FLOWS_SQL} f")
def f17(spark, sf_dir):
    sent = F.floor(F.col("bytes") / 3)
    a, s = X.direction(sent, F.col("bytes") - sent)
    return flows(spark, sf_dir).select("flow_id", F.round(a, 9).alias("asymmetry"), F.round(s, 9).alias("sent_share"))


@query("fun_f18_near_signature", f"""select flow_id, sha256(least(16, floor(log2(greatest(1, end_ms - start_ms + 1))))::int || '|' || least(24, floor(log2(greatest(1, packets))))::int || '|' || least(32, floor(log2(greatest(1, bytes))))::int || '|' || label) as signature from {FLOWS_SQL} f""")
def f18(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", X.near_signature(F.col("end_ms") - F.col("start_ms"), F.col("packets"), F.col("bytes"), F.col("label")).alias("signature"))


# --- sessions, aggregations ----------------------------------------------------------------------------------------------

_PK = """(select l_orderkey as session, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rn, l_partkey as at_ms, cast(l_quantity as bigint) as len, l_returnflag = 'N' as ahead, (l_suppkey % 32)::int as flags from lineitem)"""


def _packets(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.row_number().over(order).alias("rn"), F.col("l_partkey").alias("at_ms"), F.col("l_quantity").cast("long").alias("len"), (F.col("l_returnflag") == "N").alias("ahead"), (F.col("l_suppkey") % 32).cast("int").alias("flags"))


_STATE = "case when syn and synack and (flags & 5) <> 0 then 'ESTABLISHED_CLOSED' when syn and synack then 'ESTABLISHED_OPEN' when syn then 'INCOMPLETE_HANDSHAKE' when (flags & 4) <> 0 then 'RESET' else 'NOT_APPLICABLE_OR_UNOBSERVED' end"


@query("agg_a11_sessions", f"""with p as {_PK}, g as (select *, case when rn > 1 then greatest(0, at_ms - lag(at_ms) over (partition by session order by rn)) end as gap from p),
s as (select session, count(*) as packets, count(*) filter (ahead) as sent_packets, count(*) filter (not ahead) as got_packets, cast(coalesce(sum(len) filter (ahead), 0) as bigint) as sent, cast(coalesce(sum(len) filter (not ahead), 0) as bigint) as got, min(len) as least, max(len) as most, round(avg(len), 6) as mean, round(stddev_pop(len), 6) as deviation,
 count(gap) as gaps, round(coalesce(avg(gap), 0), 6) as gap_mean, round(coalesce(stddev_pop(gap), 0), 6) as gap_deviation, bit_or(flags) as flags, bool_or((flags & 2) <> 0 and (flags & 16) = 0) as syn, bool_or((flags & 2) <> 0 and (flags & 16) <> 0) as synack, string_agg(len || case when ahead then '>' else '<' end, ' ' order by rn) filter (rn <= 16) as first_packets from g group by 1)
select * exclude (syn, synack), {_STATE} as state from s""")
def a11(spark, sf_dir):
    """Per-direction counts, moments of lengths and gaps, flags, the handshake's state and the first 16 packets, in one shuffle."""
    ahead, f = F.col("ahead"), F.col("flags")
    gap = F.greatest(F.lit(0), F.col("at_ms") - F.lag("at_ms").over(Window.partitionBy("session").orderBy("rn")))
    p = _packets(spark, sf_dir).withColumn("gap", F.when(F.col("rn") > 1, gap))
    bit = lambda k: f.bitwiseAND(k) != 0
    total = lambda w: F.coalesce(F.sum(F.when(w, F.col("len"))), F.lit(0))
    text = F.concat(F.col("len").cast("string"), F.when(ahead, ">").otherwise("<"))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 16, F.struct("rn", text.alias("t"))))), lambda x: x["t"]), " ")
    s = p.groupBy("session").agg(
        F.count("*").alias("packets"), F.count_if(ahead).alias("sent_packets"), F.count_if(~ahead).alias("got_packets"), total(ahead).alias("sent"), total(~ahead).alias("got"), F.min("len").alias("least"), F.max("len").alias("most"),
        F.round(F.avg("len"), 6).alias("mean"), F.round(F.stddev_pop("len"), 6).alias("deviation"), F.count("gap").alias("gaps"), F.round(F.coalesce(F.avg("gap"), F.lit(0.0)), 6).alias("gap_mean"), F.round(F.coalesce(F.stddev_pop("gap"), F.lit(0.0)), 6).alias("gap_deviation"),
        F.bit_or("flags").alias("flags"), F.bool_or(bit(2) & ~bit(16)).alias("syn"), F.bool_or(bit(2) & bit(16)).alias("synack"), first.alias("first_packets"),
    )
    return s.withColumn("state", X.handshake(F.col("flags"), F.col("syn"), F.col("synack"))).drop("syn", "synack")


@query("agg_a12_rich_sessions", f"""with p as {_PK}, m as (select session, len % 5 as method, count(*) as n from p group by all), t as (select session, string_agg(method || '=' || n, ' ' order by method) as methods from m group by 1)
select session, count(*) filter (len > 20) as payload_packets, cast(coalesce(sum(len) filter (ahead and len > 20), 0) as bigint) as sent_payload, cast(sum(len) as bigint) as s1, cast(sum(len * len) as bigint) as s2, count(*) filter ((flags & 2) <> 0 and (flags & 16) = 0) as syn, count(*) filter ((flags & 2) <> 0 and (flags & 16) <> 0) as synack, count(*) filter ((flags & 4) <> 0) as rst,
 count(*) filter ((flags & 1) <> 0) as fin, any_value(methods) as methods from p join t using (session) group by 1""")
def a12(spark, sf_dir):
    """Payload, flag and method counters; a session's methods are counted first, then gathered as a short list."""
    p, f = _packets(spark, sf_dir), F.col("flags")
    bit = lambda k: f.bitwiseAND(k) != 0
    loaded = F.col("len") > 20
    main = [F.count_if(loaded).alias("payload_packets"), F.coalesce(F.sum(F.when(F.col("ahead") & loaded, F.col("len"))), F.lit(0)).alias("sent_payload"), F.sum("len").alias("s1"), F.sum(F.col("len") * F.col("len")).alias("s2"), F.count_if(bit(2) & ~bit(16)).alias("syn"), F.count_if(bit(2) & bit(16)).alias("synack"), F.count_if(bit(4)).alias("rst"), F.count_if(bit(1)).alias("fin"), F.count("*").alias("n")]
    by = p.groupBy("session", (F.col("len") % 5).alias("method")).agg(*main)
    adds = [F.sum(c).alias(c) for c in ("payload_packets", "sent_payload", "s1", "s2", "syn", "synack", "rst", "fin")]
    methods = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("method", "n"))), lambda x: F.concat_ws("=", x["method"], x["n"])), " ")
    return by.groupBy("session").agg(*adds, methods.alias("methods"))


@query("agg_a1_columns", """with u as (unpivot (select l_quantity::double as quantity, l_discount::double as discount, l_tax::double as tax, (l_linenumber * 0)::double as zero from lineitem) on quantity, discount, tax, zero into name name value v),
c as (select name, v, count(*) as n from u group by all), t as (select name, max_by(v, (n, -v)) as top, max(n) as top_n from c group by 1)
select name, count(*) as n, count(*) filter (isnan(v)) as nans, count(*) filter (isinf(v) and v > 0) as plus_inf, count(*) filter (isinf(v) and v < 0) as minus_inf, count(distinct v) as cardinality, any_value(top) as top, any_value(top_n) as top_n, count(*) filter (v = 0) * 20 >= count(*) * 19 as sparse, count(distinct v) = 1 as constant, count(distinct v) > 1 and any_value(top_n) * 100 >= count(*) * 99 as near_constant
 from u join t using (name) group by 1""")
def a1(spark, sf_dir):
    """Long form: each value's count by column, then the column's figures from those counts, so that every column takes part in one shuffle."""
    cols = {"quantity": F.col("l_quantity"), "discount": F.col("l_discount"), "tax": F.col("l_tax"), "zero": F.col("l_linenumber") * 0}
    long = read(spark, sf_dir, "lineitem").select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in cols.items()])).alias("x")).select("x.*").where("v is not null")
    c = long.groupBy("name", "v").agg(F.count("*").alias("n"))
    v, n = F.col("v"), F.col("n")
    count = lambda w: F.coalesce(F.sum(F.when(w, n)), F.lit(0))
    g = c.groupBy("name").agg(F.sum("n").alias("n"), count(F.isnan(v)).alias("nans"), count(v == float("inf")).alias("plus_inf"), count(v == float("-inf")).alias("minus_inf"), F.count("*").alias("cardinality"), F.max_by("v", F.struct("n", -v)).alias("top"), F.max("n").alias("top_n"), count(v == 0).alias("zeros"))
    return g.select("name", "n", "nans", "plus_inf", "minus_inf", "cardinality", "top", "top_n", (F.col("zeros") * 20 >= F.col("n") * 19).alias("sparse"), (F.col("cardinality") == 1).alias("constant"), ((F.col("cardinality") > 1) & (F.col("top_n") * 100 >= F.col("n") * 99)).alias("near_constant"))


@query("agg_a14_episode_sizes", f"""with o as (select *, case when start_ms - lag(start_ms) over (partition by src order by flow_id) > 86400000 then 1 else 0 end as o from {FLOWS_SQL} f), e as (select *, sum(o) over (partition by src order by flow_id rows unbounded preceding) as ep from o),
l as (select src, ep, label, count(*) c from e group by all), s as (select src, ep, sum(c)::bigint as n, max(c) as top, count(*) as labels from l group by all) select quantile_cont(n, 0.5) as median, quantile_cont(n, 0.9) as p90, quantile_cont(n, 0.99) as p99, max(n) as most, count(*) filter (labels = 1) as pure, round(sum(top) / sum(n), 9) as weighted_purity from s""")
def a14(spark, sf_dir):
    e = S.gap_groups(flows(spark, sf_dir), ["src"], "start_ms", "flow_id", 86_400_000)
    s = e.groupBy("src", "episode", "label").agg(F.count("*").alias("c")).groupBy("src", "episode").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.count("*").alias("labels"))
    rest = s.agg(F.max("n").alias("most"), F.count_if(F.col("labels") == 1).alias("pure"), F.round(F.sum("top") / F.sum("n"), 9).alias("weighted_purity"))
    return G.quantiles(s, "n", {"median": 0.5, "p90": 0.9, "p99": 0.99}).drop("n").crossJoin(rest)


@query("agg_a18_shares", "select o_orderpriority as priority, o_orderstatus as status, count(*) as n, round(count(*) / sum(count(*)) over (partition by o_orderpriority), 9) as share from orders group by 1, 2")
def a18(spark, sf_dir):
    c = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("priority")), 9))


@query("agg_a20_histograms", f"select label as decision, 'action' as what, (dport % 4)::varchar as value, count(*) as n from {FLOWS_SQL} f group by 1, 3 union all select label, 'failure', (dst % 3)::varchar, count(*) from {FLOWS_SQL} f where bytes > 5000 group by 1, 3")
def a20(spark, sf_dir):
    """Several histograms from one pass: each row gives a value to each that it counts in."""
    value = lambda what, c: F.struct(F.lit(what).alias("what"), c.cast("string").alias("value"))
    both = F.array_compact(F.array(value("action", F.col("dport") % 4), F.when(F.col("bytes") > 5000, value("failure", F.col("dst") % 3))))
    return flows(spark, sf_dir).select(F.col("label").alias("decision"), F.explode(both).alias("x")).groupBy("decision", "x.what", "x.value").agg(F.count("*").alias("n"))


@query("agg_a23_both_sides", f"""with p as (select src % 4 as scope, dport as ip, dst % 20 as mac from {FLOWS_SQL} f group by all having count(*) >= 2) select 'ip' as side, scope, ip::bigint as value, count(*) as others from p group by 2, 3 having count(*) >= 2 union all select 'mac', scope, mac, count(*) from p group by 2, 3 having count(*) >= 2""")
def a23(spark, sf_dir):
    p = flows(spark, sf_dir).groupBy((F.col("src") % 4).alias("scope"), F.col("dport").cast("long").alias("ip"), (F.col("dst") % 20).alias("mac")).agg(F.count("*").alias("n")).where("n >= 2")
    side = lambda n, a: F.struct(F.lit(n).alias("side"), F.col(a).alias("value"))
    return p.select("scope", F.explode(F.array(side("ip", "ip"), side("mac", "mac"))).alias("x")).groupBy("x.side", "scope", "x.value").agg(F.count("*").alias("others")).where("others >= 2")


_A7 = ["l_orderkey", "l_partkey", "l_suppkey", "l_partkey || '-' || l_suppkey", "l_orderkey || '-' || l_linenumber", "l_returnflag || l_linestatus", "l_linenumber", "l_quantity::bigint"]


def _a7_sql() -> str:
    split = "case when l_shipdate < timestamp '1998-01-01' then 1 when l_shipdate < timestamp '2000-01-01' then 2 else 4 end"
    parts = [f"select 's{k}' as signature, cast({e} as varchar) as v, bit_or({split}) as m from lineitem group by 2" for k, e in enumerate(_A7)]
    return f"with g as ({' union all '.join(parts)}) select signature, count(*) as groups, count(*) filter (m = 3) as train_validation, count(*) filter (m = 5) as train_test, count(*) filter (m = 6) as validation_test, count(*) filter (m = 7) as everywhere from g group by 1"


@query("agg_a7_pairwise_leakage", _a7_sql())
def a7(spark, sf_dir):
    """32 counts from one pass: for each of eight signatures, in which parts its groups are, as a bit mask."""
    split = F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"), 1).when(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp"), 2).otherwise(4)
    spark_sql = [e.replace("l_quantity::bigint", "bigint(l_quantity)") for e in _A7]
    cells = F.array(*[F.struct(F.lit(f"s{k}").alias("signature"), F.expr(e).cast("string").alias("v")) for k, e in enumerate(spark_sql)])
    g = read(spark, sf_dir, "lineitem").select(split.alias("b"), F.explode(cells).alias("x")).groupBy("x.signature", "x.v").agg(F.bit_or("b").alias("m"))
    return g.groupBy("signature").agg(F.count("*").alias("groups"), *[F.count_if(F.col("m") == m).alias(n) for m, n in ((3, "train_validation"), (5, "train_test"), (6, "validation_test"), (7, "everywhere"))])


# --- joins, sessions, samplers -------------------------------------------------------------------------------------------

_GT = f"(select 'e' || flow_id as event_id, start_ms - 600000 as a, end_ms + 600000 as b, src, dst, case when flow_id % 100 = 0 then null else dport end as dport, case when flow_id % 150 = 0 then null else packets % 3 end as proto, case when flow_id % 200 = 0 then null else bytes % 5 end as sport from {FLOWS_SQL} f where flow_id % 50 = 0)"


@query("join_j1_five_tuple", f"""with f as (select *, packets % 3 as proto, bytes % 5 as sport from {FLOWS_SQL} z), e as {_GT}, d as (select event_id, a, b, src as s, dst as t, sport as sp, dport as dp, proto, 0 as back from e union all select event_id, a, b, dst, src, dport, sport, proto, 1 from e),
h as (select f.flow_id, d.event_id, min(back) as back, bool_and(d.sp is not null and d.dp is not null) as exact from f join d on f.src = d.s and f.dst = d.t and d.a <= f.end_ms and d.b >= f.start_ms and (d.proto is null or d.proto = f.proto) and (d.sp is null or d.sp = f.sport) and (d.dp is null or d.dp = f.dport)
 and f.start_ms // 86400000 between d.a // 86400000 and d.b // 86400000 group by 1, 2)
select flow_id, count(*) as events, min(event_id) as first_event, case when count(*) > 1 then 'ambiguous' when min(back) = 1 then 'reverse_direction_time' when bool_and(exact) then 'exact_5tuple_time' else 'wildcard_port_time' end as rule from h group by 1""")
def j1(spark, sf_dir):
    f = flows(spark, sf_dir).withColumns({"proto": F.col("packets") % 3, "sport": F.col("bytes") % 5})
    some = lambda c, n: F.when(F.col("flow_id") % n != 0, F.col(c))
    e = f.where("flow_id % 50 = 0").select(F.concat(F.lit("e"), "flow_id").alias("event_id"), (F.col("start_ms") - 600_000).alias("a"), (F.col("end_ms") + 600_000).alias("b"), "src", "dst", some("sport", 200).alias("sport"), some("dport", 100).alias("dport"), some("proto", 150).alias("proto"))
    return J.match_five_tuples(f, e)


@query("join_j3_bounded", f"""with f as {FLOWS_SQL}, b as (select src, start_ms, max(flow_id) as session, max(end_ms) + 3600000 as until from f where flow_id % 4 = 0 group by all) select a.flow_id, case when a.start_ms <= b.until then b.session end as session from f a asof left join b on a.src = b.src and a.start_ms >= b.start_ms""")
def j3(spark, sf_dir):
    """The latest session that has begun, if it has not ended: the upper bound is checked after the sort, not in it."""
    f = flows(spark, sf_dir)
    right = f.where("flow_id % 4 = 0").groupBy("src", "start_ms").agg(F.max("flow_id").alias("session"), (F.max("end_ms") + 3_600_000).alias("until"))
    out = J.as_of(f.select("flow_id", "src", F.col("start_ms").alias("moment")), right, ["src"], "moment", "start_ms", ["session", "until"], "session")
    return out.select("flow_id", F.when(F.col("moment") <= F.col("until"), F.col("session")).alias("session"))


@query("join_j15_single_pairs", "with a as (select conv_id, turn, text from conversations where role = 'user'), b as (select conv_id, turn - 1 as turn, count(*) as k, max(length(text)) as answered from conversations where role = 'assistant' group by 1, 2) select a.conv_id, a.turn, b.answered, coalesce(b.k, 0) = 1 as single from a left join b using (conv_id, turn)")
def j15(spark, sf_dir):
    """Pairs with the check that each has exactly one partner."""
    c = read(spark, sf_dir, "conversations")
    b = c.where("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.count("*").alias("k"), F.max(F.length("text")).cast("long").alias("answered"))
    return c.where("role = 'user'").select("conv_id", "turn").join(b, ["conv_id", "turn"], "left").select("conv_id", "turn", "answered", (F.coalesce("k", F.lit(0)) == 1).alias("single"))


@query("join_j16_decisions", f"""with s as (select src, count(*) as n, count(distinct label) as k, max(label) as label, count(*) filter (label = 'error') as bad, count(distinct dport) as ports from {FLOWS_SQL} f group by 1)
select src, case when n < 3 then 'no_evidence' when k = 1 then 'direct' when bad * 2 > n then 'majority_error' when bad = 0 then 'benign_mixed' when ports = 1 then 'single_service_mixed' else 'ambiguous' end as decision, case when n >= 3 and k = 1 then label when n >= 3 and bad * 2 > n then 'error' end as label from s""")
def j16(spark, sf_dir):
    s = flows(spark, sf_dir).groupBy("src").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k"), F.max("label").alias("label"), F.count_if(F.col("label") == "error").alias("bad"), F.count_distinct("dport").alias("ports"))
    table = F.when(F.col("n") < 3, "no_evidence").when(F.col("k") == 1, "direct").when(F.col("bad") * 2 > F.col("n"), "majority_error").when(F.col("bad") == 0, "benign_mixed").when(F.col("ports") == 1, "single_service_mixed").otherwise("ambiguous")
    label = F.when(table == "direct", F.col("label")).when(table == "majority_error", "error")
    return s.select("src", table.alias("decision"), label.alias("label"))


@query("ses_z1_bidirectional", f"""with f as (select *, dst as peer, least(src % 50, dst % 50) as lo, greatest(src % 50, dst % 50) as hi from {FLOWS_SQL} z), b as (select *, max(end_ms) over (partition by lo, hi order by start_ms, flow_id rows between unbounded preceding and 1 preceding) as before from f),
o as (select *, sum(case when before is not null and start_ms - before > 60000 then 1 else 0 end) over (partition by lo, hi order by start_ms, flow_id rows unbounded preceding) as session from b)
select lo, hi, session::bigint as session, count(*) as n, arg_min(src % 50, (start_ms, flow_id)) as initiator, min(start_ms) as first_ms, max(end_ms) as last_ms from o group by 1, 2, 3""")
def z1(spark, sf_dir):
    """Sessions of unordered pairs; the initiator is the sender of the first row."""
    f = flows(spark, sf_dir).withColumns({"a": F.col("src") % 50, "b": F.col("dst") % 50}).select("*", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    s = S.sessionize(f, ["lo", "hi"], "start_ms", "end_ms", 60_000, "flow_id")
    return s.groupBy("lo", "hi", "session").agg(F.count("*").alias("n"), F.min_by("a", F.struct("start_ms", "flow_id")).alias("initiator"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


@query("spl_z10_open_world", f"""with d as (select src, label, cast(cast('0x' || substr(sha256('ow' || src), 1, 15) as bigint) % 100 as bigint) as b from {FLOWS_SQL} f) select label, case when label = 'error' then 'unknown' when b < 60 then 'fit' when b < 80 then 'calibration' else 'evaluation' end as part, count(*) as n from d group by 1, 2""")
def z10(spark, sf_dir):
    """60/20/20 of the known classes by group; a held-out class is a part of its own."""
    b = S.bucket(F.sha2(F.concat(F.lit("ow"), F.col("src").cast("string")), 256), 100)
    part = F.when(F.col("label") == "error", "unknown").when(b < 60, "fit").when(b < 80, "calibration").otherwise("evaluation")
    return flows(spark, sf_dir).groupBy("label", part.alias("part")).agg(F.count("*").alias("n"))


@query("spl_z13_oof_masks", f"""with g as (select flow_id, src, label, cast(cast('0x' || substr(sha256(src::varchar), 1, 15) as bigint) % 5 as int) as fold from {FLOWS_SQL} f), r as (select unnest(range(5))::int as held)
select held, count(*) filter (fold = held) as evaluated, count(*) filter (fold <> held and label <> 'error') as fitted, (select count(*) from (select src from g x group by src having count(distinct (x.fold = r.held)) > 1)) as leaked from g, r group by held""")
def z13(spark, sf_dir):
    """Masks of each fold and the check that no group is on both sides, counted from the rows on either side."""
    g = flows(spark, sf_dir).select("src", "label", S.bucket(F.sha2(F.col("src").cast("string"), 256), 5).alias("fold"))
    sides = g.select("src", "label", F.explode(F.array(*[F.struct(F.lit(k).alias("held"), (F.col("fold") == k).alias("inside")) for k in range(5)])).alias("x")).select("src", "label", "x.*")
    per = sides.groupBy("held", "src").agg(F.count_if("inside").alias("evaluated"), F.count_if(~F.col("inside") & (F.col("label") != "error")).alias("fitted"), F.min("inside").alias("a"), F.max("inside").alias("b"))
    return per.groupBy("held").agg(F.sum("evaluated").alias("evaluated"), F.sum("fitted").alias("fitted"), F.count_if(F.col("a") != F.col("b")).alias("leaked"))


@query("smp_z16_capacity", "with r as (select doc_id, lang, row_number() over (partition by lang, sha256(text) order by sha256('s|' || doc_id), doc_id) rn from documents), k as (select *, row_number() over (partition by lang order by sha256('s|' || doc_id), doc_id) as pick from r where rn = 1) select lang, doc_id, pick from k where pick <= 60")
def z16(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    one = P.representative(d, ["lang", "h"], [P.seeded("s", "doc_id"), "doc_id"])
    return P.head(one, ["lang"], [P.seeded("s", "doc_id"), "doc_id"], 60).select("lang", "doc_id", F.col("rank").cast("long").alias("pick"))


@query("smp_z18_three_stages", f"""with f as (select *, sha256('z|' || flow_id) as rk from {FLOWS_SQL} f), a as (select *, row_number() over (partition by label, dport order by rk, flow_id) as near, row_number() over (partition by label, src, dst order by rk, flow_id) as exact from f),
s as (select *, case when near = 1 then 1 when exact = 1 then 2 when exact <= 3 then 3 end as stage from a), p as (select *, row_number() over (partition by label order by stage, rk, flow_id) as pick from s where stage is not null) select label, flow_id, stage from p where pick <= 200""")
def z18(spark, sf_dir):
    """First one of each near group, then one of each exact group, then up to three of an exact group, within a class's budget."""
    f = flows(spark, sf_dir).withColumn("rk", P.seeded("z", "flow_id"))
    rank = lambda *g: F.row_number().over(Window.partitionBy("label", *g).orderBy("rk", "flow_id"))
    a = f.withColumns({"near": rank("dport"), "exact": rank("src", "dst")})
    s = a.withColumn("stage", F.when(F.col("near") == 1, 1).when(F.col("exact") == 1, 2).when(F.col("exact") <= 3, 3)).where("stage is not null")
    return P.head(s, ["label"], ["stage", "rk", "flow_id"], 200).select("label", "flow_id", "stage")


@query("smp_z23_block_draw", f"""with c as (select start_ms // 604800000 as block, count(*) n from {FLOWS_SQL} f group by 1), q as (select *, n * 500 // sum(n) over () as fl, (n * 500) % sum(n) over () as rm from c), k as (select *, row_number() over (order by rm desc, block) k, 500 - sum(fl) over () as spare from q),
t as (select block, fl + case when k <= spare then 1 else 0 end as quota from k), r as (select flow_id, start_ms // 604800000 as block, row_number() over (partition by start_ms // 604800000 order by sha256('d|' || flow_id), flow_id) as pick from {FLOWS_SQL} f) select flow_id, block from r join t using (block) where pick <= quota""")
def z23(spark, sf_dir):
    """Quotas by largest remainder, then a draw within each block in order of a seeded digest."""
    f = flows(spark, sf_dir).withColumn("block", F.floor(F.col("start_ms") / 604_800_000))
    q = P.largest_remainder(f.groupBy("block").agg(F.count("*").alias("n")), "n", 500, ["block"]).select("block", "quota")
    ranked = P.head(f, ["block"], [P.seeded("d", "flow_id"), "flow_id"], 500)
    return ranked.join(F.broadcast(q), "block").where(F.col("rank") <= F.col("quota")).select("flow_id", "block")


@query("win_w14_beacons", f"""with g as (select src, start_ms - lag(start_ms) over (partition by src order by start_ms) as gap from {FLOWS_SQL} f), p as (select src, count(*) as n, avg(gap / 1000) as mean, stddev_pop(gap / 1000) as dev from g where gap > 0 group by 1)
select src, n as intervals, round(mean, 6) as mean, round(case when n > 1 then dev / mean else 0 end, 6) as cv, round(case when n >= 3 then greatest(0, least(1, 1 - dev / mean)) else 0 end, 6) as beacon from p""")
def w14(spark, sf_dir):
    """Mean, variation and beacon score of the positive gaps of each source."""
    gap = (F.col("start_ms") - F.lag("start_ms").over(Window.partitionBy("src").orderBy("start_ms"))) / 1000
    p = flows(spark, sf_dir).withColumn("gap", gap).where("gap > 0").groupBy("src").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("dev"))
    cv = F.when(F.col("n") > 1, F.col("dev") / F.col("mean")).otherwise(0.0)
    beacon = F.when(F.col("n") >= 3, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv))).otherwise(0.0)
    return p.select("src", F.col("n").alias("intervals"), F.round("mean", 6).alias("mean"), F.round(cv, 6).alias("cv"), F.round(beacon, 6).alias("beacon"))


@query("txt_r3_chunks_capped", r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents), c as (select doc_id, unnest(range(0, greatest(len(w), 1), 128)) as start, w from w), t as (select doc_id, start, rtrim(substring(array_to_string(w[start + 1:start + 160], ' '), 1, 2400)) as t from c)
select doc_id, start::bigint as start, length(t)::bigint as n, sha256(t) as digest from t where length(t) >= 40 and not contains(lower(t), 'license')""")
def r3(spark, sf_dir):
    """Word windows of at most 2,400 characters; those under 40 and those with a denied term go."""
    from tidewell.operators import retrieval as R

    c = R.word_chunks(read(spark, sf_dir, "documents"), "doc_id", "text", 160, 32)
    t = c.withColumn("t", F.rtrim(F.substring(F.array_join("words", " "), 1, 2400)))
    return t.where((F.length("t") >= 40) & ~F.contains(F.lower("t"), F.lit("license"))).select("doc_id", "start", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("digest"))


@query("cmp_x1_presets", f"""with c as (select label, dport % 3 as split, count(*) as n, count(distinct src) as hosts from {FLOWS_SQL} f group by 1, 2), a as (select label, split, n, hosts, case when label = 'error' then 'U_final' when n >= 100 then 'K_known' else 'K_low' end as role from c)
select role, split, count(*) as labels, sum(n)::bigint as n, array_to_string(list_sort(list(label)), ' ') as names from a group by 1, 2""")
def x1(spark, sf_dir):
    """Manifests are filters, not rows: for each role and part, the labels that it takes and how many rows they have."""
    c = flows(spark, sf_dir).groupBy("label", (F.col("dport") % 3).alias("split")).agg(F.count("*").alias("n"))
    role = F.when(F.col("label") == "error", "U_final").when(F.col("n") >= 100, "K_known").otherwise("K_low")
    return c.groupBy(role.alias("role"), "split").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("label")), " ").alias("names"))


@query("cmp_x12_revision", f"""with f as (select *, src % 4 as capture from {FLOWS_SQL} z), r as (select capture, start_ms, row_number() over (partition by capture order by start_ms, flow_id) rn, count(*) over (partition by capture) n from f), b as (select capture, max(start_ms) filter (rn = least(n, n * 7 // 10 + 1)) as x, max(start_ms) filter (rn = least(n, n * 85 // 100 + 1)) as y from r group by 1),
a as (select f.*, case when end_ms <= x - 2500 then 'train' when start_ms >= x + 2500 and end_ms <= y - 2500 then 'validation' when start_ms >= y + 2500 then 'test' else 'quarantine' end as split from f join b using (capture)),
o as (select flow_id, label, case when flow_id % 97 = 0 then 'quarantine' else split end as split, src, dst from a) select label, split, count(*) as n, count(distinct src) as exact, count(distinct dst) as near, case when count(distinct dst) = 0 then 'ZERO' when count(distinct dst) < 30 then 'CRITICAL_LOW' when count(distinct dst) < 100 then 'LOW' else 'ADEQUATE' end as support from o group by 1, 2""")
def x12(spark, sf_dir):
    """Boundaries by rank, assignment with embargo, an overlay of revised rows, and the readiness of what results, in one plan."""
    f = flows(spark, sf_dir).withColumn("capture", F.col("src") % 4)
    by = f.groupBy("capture", "start_ms").agg(F.count("*").alias("c"))
    run = G.running_by_range(by, "start_ms", {"under": "c"}, groups=["capture"]).join(by.groupBy("capture").agg(F.sum("c").alias("n")), "capture")
    rank = lambda a, b: F.least(F.col("n"), F.floor(F.col("n") * a / b) + 1)
    at = lambda a, b: F.max(F.when((F.col("under") < rank(a, b)) & (rank(a, b) <= F.col("under") + F.col("c")), F.col("start_ms")))
    bounds = run.groupBy("capture").agg(at(7, 10).alias("x"), at(85, 100).alias("y"))
    a = f.join(bounds, "capture").withColumn("split", S.embargo_split("start_ms", "end_ms", F.col("x"), F.col("y"), 5000))
    revised = f.where("flow_id % 97 = 0").select("flow_id", F.lit("quarantine").alias("split"))
    o = J.overlay(a, revised, ["flow_id"], ["split"])
    c = o.groupBy("label", "split").agg(F.count("*").alias("n"), F.count_distinct("src").alias("exact"), F.count_distinct("dst").alias("near"))
    return c.withColumn("support", X.tier(F.col("near"), [1, 30, 100], ["ZERO", "CRITICAL_LOW", "LOW", "ADEQUATE"]))


@query("cmp_x10_context_rates", f"""with f as (select *, src % 4 as scope from {FLOWS_SQL} z), w as (select t.flow_id, t.label, count(c.flow_id) as prior, count(distinct c.dport) as ports from f t left join f c on c.src = t.src and c.start_ms < t.start_ms and c.start_ms >= t.start_ms - 518400000 group by 1, 2)
select label, count(*) as n, count(*) filter (prior >= 8) as busy, count(*) filter (ports >= 5) as diverse, round(count(*) filter (prior >= 8) / count(*), 9) as rate from w group by 1""")
def x10(spark, sf_dir):
    """From raw rows to contexts to rates for each class."""
    from tidewell.operators import context as C

    f = flows(spark, sf_dir)
    c = C.past_context(f, ["src"], "flow_id", "start_ms", "start_ms", {"w": 518_400_000}, {"prior": F.lit(1)}, {"ports": F.col("dport")})
    w = f.select("flow_id", "label").join(c, "flow_id")
    return w.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("prior_w") >= 8).alias("busy"), F.count_if(F.col("ports_w") >= 5).alias("diverse"), F.round(F.count_if(F.col("prior_w") >= 8) / F.count("*"), 9).alias("rate"))


@query("val_p9_event_ids", f"select count(*)::bigint as n, count(distinct (src, dst, label))::bigint as ids from {FLOWS_SQL} f")
def event_ids(spark, sf_dir):
    """Ids made of a row's values: as many as there are different rows."""
    return flows(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct(V.event_id(["src", "dst", "label"])).alias("ids"))
