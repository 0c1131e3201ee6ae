"""Queries of the text scans, over flow rows written as lines of text, and of the validation of what was read."""

from pyspark.sql import functions as F

from tidewell.functions import validation as V
from tidewell.plans.registry import query, read
from tidewell.sources import captures as C
from tidewell.sources import scans as S
from tidewell.sources import sinks as K
from tidewell.sources.flows import FLOWS_SQL, flows

NAMES = ["flow_id", "start_ms", "end_ms", "src", "dst", "dport", "bytes", "packets", "label"]
_SCHEMA = "flow_id long, start_ms long, end_ms long, src long, dst long, dport int, bytes long, packets long, label string"
_CSV = f"concat_ws(',', {', '.join(NAMES)})"
_LINES = f"(select flow_id as line, {_CSV} as value from {FLOWS_SQL} f)"


def _lines(spark, sf_dir, value=_CSV):
    return flows(spark, sf_dir).select(F.col("flow_id").alias("line"), F.expr(value).alias("value"))


@query("src_s1_csv_audit", f"""with f as {FLOWS_SQL}, o as (select *, lag(start_ms) over (order by flow_id) as before from f)
select cast(count(*) as bigint) as row_count, cast(count(*) filter (end_ms < start_ms) as bigint) as end_before_start, cast(count(*) filter (start_ms < before) as bigint) as order_violations,
 cast(count(*) filter ((label = 'error') <> (packets > 8)) as bigint) as label_mismatches, cast(count(distinct label) as bigint) as labels, cast(count(*) filter (bytes = 0) as bigint) as zero_bytes from o""")
def s1(spark, sf_dir):
    """A strict scan and one pass of checks; order violations compare neighbours by line number, within blocks of lines and across their edges."""
    rows = S.parsed(_lines(spark, sf_dir), _SCHEMA)
    order = V.order_violations(rows, "flow_id", "start_ms")
    checks = rows.agg(
        F.count("*").alias("row_count"), F.count_if(F.col("end_ms") < F.col("start_ms")).alias("end_before_start"),
        F.count_if((F.col("label") == "error") != (F.col("packets") > 8)).alias("label_mismatches"),
        F.count_distinct("label").alias("labels"), F.count_if(F.col("bytes") == 0).alias("zero_bytes"),
    )
    return checks.crossJoin(F.broadcast(order))


@query("src_s2_projection", f"select cast(src as varchar) as src, cast(max(end_ms) as bigint) as last_ms from {FLOWS_SQL} f group by 1")
def s2(spark, sf_dir):
    """Three of nine CSV columns: the parser is given the whole schema and makes the columns that are asked for alone."""
    rows = _lines(spark, sf_dir).select(F.from_csv("value", _SCHEMA).alias("r")).select("r.src", "r.end_ms")
    return rows.groupBy(F.col("src").cast("string").alias("src")).agg(F.max("end_ms").alias("last_ms"))


_DIRTY = """concat_ws(',', flow_id, case when flow_id % 13 = 0 then '' else cast(start_ms as {text}) end, end_ms, src, case when flow_id % 17 = 0 then '' else cast(dst as {text}) end, dport,
 case when flow_id % 11 = 0 then '-5' else cast(bytes as {text}) end, packets) || case when flow_id % 7 = 0 then '' else ',' || label end"""


@query("src_s3_validated_lines", f"""with l as (select flow_id as line, start_ms, {_DIRTY.format(text='varchar')} as value from {FLOWS_SQL} f)
select line, sha256(value) as digest, array_to_string(list_filter([case when line % 7 = 0 then 'column_count' end, case when line % 13 = 0 then 'start_ms' end, case when line % 11 = 0 then 'bytes' end, case when line % 17 = 0 then 'dst' end,
 case when line % 7 = 0 then 'label' end], lambda x: x is not null), ' ') as reasons, not (line % 7 = 0 or line % 13 = 0 or line % 11 = 0 or line % 17 = 0) as critical_valid from l""")
def s3(spark, sf_dir):
    lines = _lines(spark, sf_dir, _DIRTY.format(text="string"))
    rows = S.validated(lines, NAMES, ["start_ms", "end_ms", "dport", "bytes", "packets"], ["dst", "label"], ("start_ms", "end_ms"))
    return rows.select("line", "digest", F.array_join("reasons", " ").alias("reasons"), "critical_valid")


@query("src_s4_leading_fields", f"""select src, dst, cast(count(*) as bigint) as n, cast(count(*) filter (flow_id % 9 = 0) as bigint) as unusual
 from (select cast(src as varchar) as src, cast(dst as varchar) as dst, flow_id from {FLOWS_SQL} f) group by 1, 2""")
def s4(spark, sf_dir):
    lines = _lines(spark, sf_dir, "concat_ws(',', src, dst, label) || case when flow_id % 9 = 0 then ',,a,b' else ',' end")
    return S.leading_fields(lines, ["src", "dst", "label"], 3).groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_if(~F.col("usual")).alias("unusual"))


@query("src_s5_last_two_fields", f"select flow_id as line, case when flow_id % 19 = 0 then null else cast(packets as varchar) end as kind, case when flow_id % 19 = 0 then null else label end as label from {FLOWS_SQL} f")
def s5(spark, sf_dir):
    lines = _lines(spark, sf_dir, f"case when flow_id % 19 = 0 then 'torn,line' else {_CSV} end")
    return S.last_two_fields(lines, ("kind", "label")).select("line", "kind", "label")


@query("src_s6_headed_log", f"""select flow_id + 1 as row, case when flow_id % 23 = 0 then null else cast(src as varchar) end as host, case when flow_id % 23 = 0 then null else label end as service,
 case when flow_id % 23 = 0 then 'field_count_mismatch' end as error from {FLOWS_SQL} f""")
def s6(spark, sf_dir):
    """Two lines of comments before the rows; the second names the fields."""
    text = F.expr("concat_ws('\t', src, label) || case when flow_id % 23 = 0 then '\tx' else '' end")
    rows = flows(spark, sf_dir).select((F.col("flow_id") + 2).alias("line"), text.alias("value"))
    head = spark.createDataFrame([(0, "#separator x"), (1, "#fields\thost\tservice")], "line long, value string")
    return S.headed_log(head.union(rows), ["host", "service"])


_PACKETS = """select flow_id as frame, start_ms / 1000 as time, bytes as length, case when flow_id % 5 = 0 then '2001:db8::' || src else '10.0.0.' || src end as src, '10.1.0.' || dst as dst,
 case when flow_id % 5 = 0 then 'IPv6' else 'IPv4' end as l3, case when flow_id % 3 = 0 then 'TCP' when flow_id % 3 = 1 then 'UDP' when flow_id % 2 = 0 then 'ICMP' else 'IP_47' end as l4,
 case when flow_id % 3 < 2 then 1000 + dport else 0 end as sport, case when flow_id % 3 < 2 then 80 + dport else 0 end as dport, case when flow_id % 3 = 0 then 18 else 0 end as flags"""


@query("src_s8_packets", f"""select frame, cast(length as bigint) as length, src, dst, l3, l4, cast(sport as bigint) as sport, cast(dport as bigint) as dport, cast(flags as bigint) as flags from ({_PACKETS} from {FLOWS_SQL} f where flow_id % 29 <> 0)""")
def s8(spark, sf_dir):
    f = flows(spark, sf_dir)
    text = lambda sql: F.expr(sql).cast("string")
    cols = {
        "frame.number": "flow_id", "frame.time_epoch": "start_ms / 1000", "frame.len": "bytes || ',7'", "ip.src": "if(flow_id % 5 = 0, '', '10.0.0.' || src)", "ipv6.src": "if(flow_id % 5 = 0, '2001:db8::' || src, '')",
        "ip.dst": "if(flow_id % 29 = 0, '', '10.1.0.' || dst)", "ipv6.dst": "''", "ip.proto": "case when flow_id % 3 = 0 then '6' when flow_id % 3 = 1 then '17' when flow_id % 2 = 0 then '1' else '47' end", "ipv6.nxt": "''",
        "tcp.srcport": "if(flow_id % 3 = 0, string(1000 + dport), '')", "tcp.dstport": "if(flow_id % 3 = 0, string(80 + dport), '')", "udp.srcport": "if(flow_id % 3 = 1, string(1000 + dport), '')", "udp.dstport": "if(flow_id % 3 = 1, string(80 + dport), '')", "tcp.flags": "if(flow_id % 3 = 0, '0x12', '')",
    }
    return S.packets(f.select(*[text(sql).alias(n.replace(".", "_")) for n, sql in cols.items()])).drop("time")


@query("src_s13_json_lines", f"select case when flow_id % 31 = 0 then null else flow_id end as id, case when flow_id % 31 = 0 then null else label end as label, flow_id % 31 = 0 as bad from {FLOWS_SQL} f where flow_id % 37 <> 0")
def s13(spark, sf_dir):
    lines = flows(spark, sf_dir).select(F.expr("case when flow_id % 37 = 0 then ' ' when flow_id % 31 = 0 then '{\"id\": ' else to_json(named_struct('id', flow_id, 'label', label)) end").alias("value"))
    return S.json_lines(lines, "id long, label string").select("id", "label", F.col("bad").isNotNull().alias("bad"))


@query("src_s15_bundle_parents", "select 'T' || n_nationkey as external_id, case when n_nationkey % 3 = 0 then 'T' || n_nationkey else 'T' || n_nationkey - n_nationkey % 3 end as parent_id from nation where n_nationkey % 7 <> 6 and (n_nationkey % 3 = 0 or (n_nationkey - n_nationkey % 3) % 7 <> 6) union all select 'T' || n_nationkey, 'T' || n_nationkey from nation where n_nationkey % 7 <> 6 and n_nationkey % 3 <> 0 and (n_nationkey - n_nationkey % 3) % 7 = 6")
def s15(spark, sf_dir):
    """Nations as the patterns of a bundle of JSON objects, each third one the parent of the two that follow; each seventh is revoked."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    pattern = F.expr("named_struct('id', 'p' || k, 'type', 'attack-pattern', 'revoked', k % 7 = 6, 'relationship_type', cast(null as string), 'source_ref', cast(null as string), 'target_ref', cast(null as string), 'external_references', array(named_struct('external_id', 'T' || k)))")
    link = F.expr("named_struct('id', 'r' || k, 'type', 'relationship', 'revoked', false, 'relationship_type', 'subtechnique-of', 'source_ref', 'p' || k, 'target_ref', 'p' || (k - k % 3), 'external_references', cast(null as array<struct<external_id: string>>))")
    objects = n.select(F.explode(F.array(pattern, F.when(F.col("k") % 3 != 0, link))).alias("o")).where("o is not null")
    return S.parents(S.bundle_objects(objects.select(F.to_json(F.struct(F.array("o").alias("objects"))).alias("value"))))


# --- validation ----------------------------------------------------------------------------------------------------------


@query("val_p1_feature_projection", f"select sum(bytes)::bigint as bytes, sum(packets)::bigint as packets, sum(dport)::bigint as dport from {FLOWS_SQL} f")
def p1(spark, sf_dir):
    roles = {"flow_id": "identity", "start_ms": "time", "end_ms": "time", "src": "identity", "dst": "identity", "dport": "model_feature", "bytes": "model_feature", "packets": "model_feature", "label": "label"}
    rows = V.features(flows(spark, sf_dir), roles)
    return rows.agg(*[F.sum(c).cast("long").alias(c) for c in rows.columns])


_VIEW = "(select l_orderkey, l_linenumber, l_quantity::bigint as q from lineitem)"


@query("val_p2_initial_view", f"""with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, q) as rn from {_VIEW} v)
select l_orderkey, array_to_string(list(q order by rn) filter (rn <= 8), ' ') as first_packets, least(count(*), 8)::bigint as shown from r group by 1""")
def p2(spark, sf_dir):
    s = V.packet_lists(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q")), ["l_orderkey"], ["l_linenumber", "q"], ["q"])
    v = V.initial_view(s, "packets")
    return v.select("l_orderkey", F.array_join(F.transform("packet_sequence", lambda p: p["q"].cast("string")), " ").alias("first_packets"), F.size("packet_sequence").cast("long").alias("shown"))


@query("val_p3_later_packets", f"""with r as (select *, row_number() over (partition by l_orderkey % 500 order by l_orderkey, l_linenumber, q) as rn, l_orderkey % 500 as k from {_VIEW} v)
select k, array_to_string(list(q order by rn) filter (rn between 9 and 16), ' ') as later from r group by 1 having count(*) > 8""")
def p3(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("k"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    s = V.later_packets(V.packet_lists(rows, ["k"], ["l_orderkey", "l_linenumber", "q"], ["q"], 16), "packets")
    return s.select("k", F.array_join(F.transform("packets", lambda p: p["q"].cast("string")), " ").alias("later"))


@query("val_p4_allow_list", """select event_id, props is not null and json_keys(props) = ['k'] as exact_keys, case when json_keys(props) = ['k'] then try_cast(json_extract_string(props, '$.k') as bigint) end as k from events""")
def p4(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    fits = V.exact_keys("props", ["k"])
    return e.select("event_id", fits.alias("exact_keys"), F.when(fits, F.get_json_object("props", "$.k").try_cast("bigint")).alias("k"))


@query("val_p5_prohibited_content", r"""select doc_id, coalesce(regexp_matches(text, '(^|[^0-9])([0-9]{1,3}\.){3}[0-9]{1,3}([^0-9]|$)'), false) as address, coalesce(regexp_matches(text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-2][0-9]:[0-5][0-9]'), false) as time,
 coalesce(contains(replace(lower(text), '-', '_'), 'source_ip') or contains(replace(lower(text), '-', '_'), 'license'), false) as name from documents""")
def p5(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", *V.prohibited("text", ["source_ip", "license"]))


@query("val_p6_forbidden_keys")
def p6(spark, sf_dir):
    """No SQL: a walk through nested JSON; held against brute force in the tests."""
    value = F.to_json(F.struct(F.lit(1).alias("ok"), F.struct(F.col("label").alias("Label"), F.array(F.struct(F.col("src").alias("src_ip"))).alias("hops")).alias("session")))
    return flows(spark, sf_dir).select("flow_id", F.array_join(V.forbidden_keys(value, {"label", "src_ip"}), " ").alias("paths"))


@query("val_p8_eligible", f"""select label, count(*)::bigint as n, count(*) filter (bytes >= 100 and label in ('click', 'error'))::bigint as eligible from {FLOWS_SQL} f group by 1""")
def p8(spark, sf_dir):
    rows = flows(spark, sf_dir).withColumn("critical_valid", F.col("bytes") >= 100)
    return rows.withColumn("e", V.eligible("critical_valid", V.taxonomy("label", {"click": "a", "error": "b"}))).groupBy("label").agg(F.count("*").alias("n"), F.count_if("e").alias("eligible"))


@query("val_p9_events", f"""select flow_id, start_ms, case when flow_id % 4 = 0 then start_ms + 600000 else end_ms end as end_ms, case flow_id % 5 when 0 then 6 when 1 then 17 when 2 then 1 when 3 then 47 end as protocol,
 case when flow_id % 6 = 0 then null else dport end as port, case when flow_id % 4 <> 0 and end_ms < start_ms then 'ends before it starts' when flow_id % 5 = 4 and flow_id % 2 = 1 then 'unsupported protocol' end as error from {FLOWS_SQL} f""")
def p9(spark, sf_dir):
    text = flows(spark, sf_dir).selectExpr("flow_id", "cast(start_ms as string) as start", "if(flow_id % 4 = 0, '', cast(end_ms as string)) as end", "case flow_id % 5 when 0 then 'TCP' when 1 then ' udp' when 2 then 'icmp' when 3 then '47' else if(flow_id % 2 = 1, 'sctp', 'any') end as protocol", "if(flow_id % 6 = 0, '*', cast(dport as string)) as port")
    return V.events(text, "milliseconds", 600_000).select("flow_id", "start_ms", "end_ms", "protocol", "port", "error")


@query("val_p10_authorised", f"""select label as role, count(*)::bigint as n from {FLOWS_SQL} f where label in ('click', 'view') group by 1""")
def p10(spark, sf_dir):
    return V.authorised(flows(spark, sf_dir).where("label in ('click', 'view')"), "label", ["error"]).groupBy(F.col("label").alias("role")).agg(F.count("*").alias("n"))


@query("val_p11_first_asset", "select n_regionkey as role, min_by(n_name, n_nationkey) as asset from nation where n_name > 'E' group by 1")
def p11(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumn("role", F.col("n_regionkey"))
    return V.first_of(n.where("n_name > 'E'"), ["role"], "n_nationkey", F.col("n_name").alias("asset"))


@query("val_p12_taxonomy", f"""select flow_id, case when contains(lower(label), 'err') then 'Fault' when contains(lower(label), 'click') then 'Use' when contains(lower(label), 'view') then 'Use' end as broad, case label when 'click' then 'c' when 'error' then 'e' end as exact from {FLOWS_SQL} f""")
def p12(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", V.first_token("label", [("err", "Fault"), ("click", "Use"), ("view", "Use")]).alias("broad"), V.taxonomy("label", {"click": "c", "error": "e"}).alias("exact"))


@query("val_p13_scope_guard", f"select count(*)::bigint as n, (count(*) - count(distinct flow_id))::bigint as repeated, count(*) filter (end_ms < start_ms)::bigint as unordered, count(distinct src % 4)::bigint as scopes from {FLOWS_SQL} f")
def p13(spark, sf_dir):
    return V.scope_checks(flows(spark, sf_dir).withColumn("scope", F.col("src") % 4), "flow_id", "start_ms", "end_ms", "scope")


_ADDRESS = "case flow_id % 6 when 0 then '224.0.0.' || dst when 1 then '127.0.0.1' when 2 then '10.0.' || dst || '.' || src % 256 when 3 then '0.0.0.0' when 4 then 'host' || dst else '255.255.255.255' end"


@query("val_p14_unicast", f"select flow_id, flow_id % 6 = 2 as unicast from {FLOWS_SQL} f")
def p14(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", V.unicast(F.expr(_ADDRESS)).alias("unicast"))


@query("val_p15_address_match", f"""select flow_id, flow_id % 6 = 2 and dst < 64 as in_net, coalesce(regexp_matches({_ADDRESS}, '^10\\.0\\.1.\\..*$'), false) as in_glob, true as anything, dport = 5 as port from {FLOWS_SQL} f""")
def p15(spark, sf_dir):
    a = F.expr(_ADDRESS)
    return flows(spark, sf_dir).select("flow_id", V.address_match(a, "10.0.0.0/18").alias("in_net"), V.address_match(a, "10.0.1?.*").alias("in_glob"), V.address_match(a, "").alias("anything"), V.port_match(F.col("dport"), "5").alias("port"))


# --- sinks and stores ----------------------------------------------------------------------------------------------------


@query("src_s12_files", "select 'events.parquet' as file, count(*)::bigint as n, count(distinct user_id)::bigint as users from events")
def s12(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.regexp_replace("_metadata.file_path", r"^.*?([^/]+\.parquet)(/.*)?$", "$1").alias("file"), "user_id")
    return e.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("src_s11_partition_gate", f"select count(*)::bigint as n from {FLOWS_SQL} f where label = 'click'")
def s11(spark, sf_dir):
    at = K.scratch(spark, "flows")
    K.write_shards(flows(spark, sf_dir), at, ["label"])
    one = K.same_schema(spark.read.parquet(K.partition_path(at, label="click")), set(NAMES) - {"label"})
    return one.agg(F.count("*").alias("n"))


@query("snk_k1_shards", f"select label, count(*)::bigint as n, sum(bytes)::bigint as bytes from {FLOWS_SQL} f group by 1")
def k1(spark, sf_dir):
    at = K.scratch(spark, "flows")
    K.write_shards(flows(spark, sf_dir), at, ["label"], 1000)
    return spark.read.parquet(at).groupBy("label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("snk_k2_logical_hash")
def k2(spark, sf_dir):
    """No SQL: the digest is of Spark's JSON; the tests hold it to be the same for any order and number of files."""
    return K.logical_hash(flows(spark, sf_dir))


@query("snk_k3_text", f"select flow_id, label, case when flow_id % 3 = 0 then null else src end as src from {FLOWS_SQL} f")
def k3(spark, sf_dir):
    rows = flows(spark, sf_dir).select("flow_id", "label", F.expr("if(flow_id % 3 = 0, null, src)").alias("src"))
    out = []
    for kind, part in (("json", 0), ("csv", 1)):
        K.write_text(rows.where(F.col("flow_id") % 2 == part), at := K.scratch(spark, kind), kind)
        reader = spark.read.schema(rows.schema)
        out.append(reader.json(at) if kind == "json" else reader.option("header", True).csv(at))
    return out[0].union(out[1])


@query("snk_k4_replace", f"""select src % 4 as capture, count(*)::bigint as n, sum(case when src % 4 = 1 then bytes + 1 else bytes end)::bigint as bytes from {FLOWS_SQL} f where src % 4 <> 2 group by 1""")
def k4(spark, sf_dir):
    rows, at = flows(spark, sf_dir).select("flow_id", "bytes", (F.col("src") % 4).alias("capture")), K.scratch(spark, "catalog")
    K.replace_partitions(rows, at, ["capture"])
    K.replace_partitions(rows.where("capture = 1").withColumn("bytes", F.col("bytes") + 1), at, ["capture"])
    K.delete_partition(spark, at, capture=2)
    return spark.read.schema("flow_id long, bytes long, capture long").parquet(at).groupBy("capture").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


_RECORDS = "select flow_id % 700 as key, flow_id as seq, case when flow_id % 3 = 0 then 'BAD' else 'VALID' end as status, dport % 2 as model from"


@query("snk_k6_resume", f"""with r as ({_RECORDS} {FLOWS_SQL} f), l as (select key, max_by(status, seq) as status, max_by(model, seq) as model from r group by 1)
select key, model from (select distinct flow_id % 900 as key, 1 as model from {FLOWS_SQL} g) a where not exists (select 1 from l where l.key = a.key and l.status = 'VALID' and l.model = a.model)""")
def k6(spark, sf_dir):
    f = flows(spark, sf_dir)
    records = f.selectExpr("flow_id % 700 as key", "flow_id as seq", "if(flow_id % 3 = 0, 'BAD', 'VALID') as status", "dport % 2 as model")
    asked = f.selectExpr("flow_id % 900 as key", "1 as model").distinct()
    return K.still_to_do(asked, records, "key", "seq", ["model"])


@query("snk_k7_cache", f"select flow_id, case when flow_id % 5 <> 0 then label end as output from {FLOWS_SQL} f")
def k7(spark, sf_dir):
    asked = flows(spark, sf_dir).select("flow_id", "src", "dst")
    held = flows(spark, sf_dir).where("flow_id % 5 <> 0").withColumn("digest", K.request_digest("flow_id", "src", "dst")).withColumnRenamed("label", "output")
    return K.cached(asked, held, ["flow_id", "src", "dst"], "output").select("flow_id", "output")


@query("src_s7_capture", f"""select flow_id as frame, 60 + packets as length, '10.0.0.' || src % 256 as src, '10.1.0.' || dst as dst, case when flow_id % 2 = 0 then 'TCP' else 'UDP' end as l4, 1000 + dport as sport, 80 as dport, case when flow_id % 2 = 0 then 18 else 0 end as flags
 from {FLOWS_SQL} f""".replace("flow_id as frame", "flow_id").replace("60 + packets as length", "(60 + packets)::bigint as length").replace("1000 + dport as sport, 80 as dport, case when flow_id % 2 = 0 then 18 else 0 end as flags", "(1000 + dport)::bigint as sport, 80::bigint as dport, (case when flow_id % 2 = 0 then 18 else 0 end)::bigint as flags"))
def s7(spark, sf_dir):
    """Each flow as a capture of one frame, made of its bytes in hexadecimal, and decoded again."""
    h = lambda x, n: f"lpad(hex({x}), {n}, '0')"
    little = lambda x: f"concat(substring({h(x, 8)}, 7, 2), substring({h(x, 8)}, 5, 2), substring({h(x, 8)}, 3, 2), substring({h(x, 8)}, 1, 2))"
    ip = f"concat('45000028000000004006', '0000', '0A0000', {h('src % 256', 2)}, '0A0100', {h('dst', 2)})".replace("4006", "40', if(flow_id % 2 = 0, '06', '11'), '")
    body = f"concat('0000000000000000000000000800', {ip}, {h('1000 + dport', 4)}, '0050', '00000000000000005012', '0000')"
    raw = f"concat('D4C3B2A1020004000000000000000000FFFF000001000000', {little('1000')}, {little('5')}, {little(f'length({body}) / 2')}, {little('60 + packets')}, {body})"
    captures = flows(spark, sf_dir).select(F.col("flow_id").cast("string").alias("path"), F.expr(f"unhex({raw})").alias("content"))
    fields = C.decoded(captures)
    numbered = fields.withColumn("frame_number", F.col("path"))
    return S.packets(numbered).select(F.col("frame").alias("flow_id"), "length", "src", "dst", "l4", "sport", "dport", "flags")


@query("src_s16_contract", f"select sum(bytes)::bigint as bytes, sum(packets)::bigint as packets from {FLOWS_SQL} f")
def s16(spark, sf_dir):
    """A contract names the columns, their types and roles; the features are those whose role says so."""
    from tidewell.sources import contracts as Y

    kinds = {"flow_id": "identity", "start_ms": "time", "end_ms": "time", "src": "identity", "dst": "identity", "dport": "context", "bytes": "model_feature", "packets": "model_feature", "label": "label"}
    rows = flows(spark, sf_dir)
    schema = Y.schema_of({"fields": [{"name": n, "dtype": t, "role": kinds[n]} for n, t in rows.dtypes]})
    Y.check_schema(rows.schema, schema)
    chosen = V.features(rows, Y.roles_of(schema))
    return chosen.agg(*[F.sum(c).cast("long").alias(c) for c in chosen.columns])
