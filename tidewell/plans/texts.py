"""Queries of the text functions and of document retrieval."""

from pyspark.sql import functions as F

from tidewell.functions import texts as X
from tidewell.functions import validation as V
from tidewell.operators import retrieval as R
from tidewell.plans.registry import query, read
from tidewell.sources import sinks as K
from tidewell.sources.flows import FLOWS_SQL, flows


@query("fun_f2_timestamps", f"""select flow_id, case when flow_id % 17 = 0 then null else start_ms end as from_ms, (start_ms // 1000) * 1000 + 500 as from_seconds, (start_ms // 60000) * 60000 as from_iso, (start_ms // 60000) * 60000 - 7200000 as from_zone from {FLOWS_SQL} f""")
def f2(spark, sf_dir):
    minute = "date_format(timestamp_millis(start_ms), \"yyyy-MM-dd'T'HH:mm:00\")"
    t = flows(spark, sf_dir).selectExpr("flow_id", "if(flow_id % 17 = 0, 'never', ' ' || start_ms) as m", "concat(floor(start_ms / 1000), '.5') as s", f"replace({minute}, 'T', if(flow_id % 2 = 0, 'T', ' ')) || if(flow_id % 3 = 0, 'Z', '') as i", f"{minute} || '+02:00' as z")
    return t.select("flow_id", V.timestamp_ms(F.col("m"), "milliseconds").alias("from_ms"), V.timestamp_ms(F.col("s"), "seconds").alias("from_seconds"), V.timestamp_ms(F.col("i"), "iso8601").alias("from_iso"), V.timestamp_ms(F.col("z"), "iso8601").alias("from_zone"))


@query("fun_f6_cleaners", f"""select flow_id, case when flow_id % 4 = 0 then '' else label end as text, case flow_id % 5 when 0 then null when 1 then dport when 2 then null when 3 then 65535 else null end as port, 'ab' || lower(label) as name from {FLOWS_SQL} f""")
def f6(spark, sf_dir):
    t = flows(spark, sf_dir).selectExpr("flow_id", "case when flow_id % 4 = 0 then if(flow_id % 8 = 0, ' NaN ', null) else ' ' || label || '\t' end as x", "case flow_id % 5 when 0 then '80.5' when 1 then dport || '.0' when 2 then '65536' when 3 then '65535' else 'x' end as p", "if(flow_id % 2 = 0, 'Ａ b ', 'a B') || upper(label) as n")
    return t.select("flow_id", X.clean_text(F.col("x")).alias("text"), X.clean_port(F.col("p")).alias("port"), X.instance_name(F.col("n")).alias("name"))


@query("fun_f7_shapes", f"""select flow_id, '/<SEG>/' || case when flow_id % 3 = 0 then '<NUM>' when flow_id % 3 = 1 then '<FILE>.php' else '..' end || '?<QUERY_PARAM>=<NUM>&<PARAM>=' || case when flow_id % 2 = 0 then '<SQL_EXPR>' else '<EMPTY>' end as uri,
 case when flow_id % 2 = 0 then '<HOST>.com' else '<HOST>' end as host from {FLOWS_SQL} f""")
def f7(spark, sf_dir):
    t = flows(spark, sf_dir).selectExpr("flow_id", "'/app/' || case when flow_id % 3 = 0 then string(src) when flow_id % 3 = 1 then 'page%2Ephp' else '%252e%252e' end || '?id=' || dst || '&z=' || if(flow_id % 2 = 0, '1%20or%201', '') as u", "'h' || src || if(flow_id % 2 = 0, '.Com.', '.lan') as h")
    return t.select("flow_id", X.uri_shape_udf(F.col("u")).alias("uri"), X.name_shape(F.col("h")).alias("host"))


@query("fun_f8_mask", r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(substring(text, 1, 200), '[^a-z .,]', 'z', 'g'), '[a-z]{36,}', '<TOKEN>', 'g'), ' +', ' ', 'g')) as masked from documents where text is not null and length(trim(text)) > 0""")
def f8(spark, sf_dir):
    """Documents reduced to letters, so that of the masks those for long tokens and spaces alone can meet; the tests hold each mask."""
    d = read(spark, sf_dir, "documents").where("text is not null and length(trim(text)) > 0")
    return d.select("doc_id", F.coalesce(X.masked(F.regexp_replace(F.substring("text", 1, 200), "[^a-z .,]", "z")), F.lit("")).alias("masked"))


@query("fun_f8_mask_all")
def f8_all(spark, sf_dir):
    """No SQL: the chain's requests and character references go through Python."""
    return read(spark, sf_dir, "documents").select("doc_id", X.masked(F.col("text")).alias("masked"))


@query("fun_f9_hex_text", "select doc_id, case when length(text) = 0 then null else text end as text from (select doc_id, trim(regexp_replace(substring(text, 1, 300), '[^a-zA-Z0-9 .,]', '', 'g')) as text from documents where text is not null)")
def f9(spark, sf_dir):
    clean = F.trim(F.regexp_replace(F.substring("text", 1, 300), "[^a-zA-Z0-9 .,]", ""))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.hex_text(F.concat_ws(":", F.hex(clean))).alias("text"))


@query("fun_f19_json_value", "select event_id, case when event_id % 5 = 0 then null else '{\"id\":' || event_id || ',\"k\":[1,2]}' end as value from events")
def f19(spark, sf_dir):
    body = "concat('{\"k\": [1, 2], \"id\": ', event_id, '}')"
    t = f"case event_id % 5 when 0 then 'none {{' when 1 then {body} when 2 then '<think>{{\"a\":1}}</think>```json\n' || {body} || '\n```' when 3 then 'Here: ' || {body} || ' as asked.' else 'thoughts</think>' || {body} end"
    return read(spark, sf_dir, "events").select("event_id", X.json_value(F.expr(t)).alias("value"))


@query("fun_f20_compact", f"select src, count(*)::bigint as n, sum(bytes)::bigint as bytes, true as same from {FLOWS_SQL} f group by 1")
def f20(spark, sf_dir):
    """Packed and unpacked again: the items are those that went in."""
    fields = ["flow_id", "bytes", "label"]
    items = flows(spark, sf_dir).groupBy("src").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("string").alias(c) for c in fields]))).alias("items"))
    back = items.withColumn("back", X.expanded(X.compact(F.col("items"), fields), fields))
    total = F.aggregate("back", F.lit(0).cast("long"), lambda a, x: a + x["bytes"].cast("long"))
    return back.select("src", F.size("back").cast("long").alias("n"), total.alias("bytes"), (F.col("back") == F.col("items")).alias("same"))


@query("fun_f22_redact", f"select flow_id, 'user=' || src || ' password=[REDACTED], Bearer [REDACTED] [REDACTED]' as text from {FLOWS_SQL} f")
def f22(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", X.redacted(F.expr("concat('user=', src, ' password: p', dst, ', bearer ab', flow_id, '== hunter2')"), ("hunter2", "hunter")).alias("text"))


_HEAD = "'---\ntitle: N' || n_nationkey || '\ntags: x\n---\n\n# ' || n_name || '\n\n' || n_name || ' one\ntwo'"


@query("txt_r1_front_matter", "select n_nationkey, case when n_nationkey % 6 = 5 then null else 'N' || n_nationkey end as title, case when n_nationkey % 6 = 5 then null else '# ' || n_name || chr(10) || chr(10) || n_name || ' one' || chr(10) || 'two' end as body from nation")
def r1(spark, sf_dir):
    t = read(spark, sf_dir, "nation").selectExpr("n_nationkey", f"if(n_nationkey % 6 = 5, n_name, {_HEAD}) as t").withColumn("d", X.front_matter(F.col("t")))
    return t.select("n_nationkey", F.try_element_at("d.head", F.lit("title")).alias("title"), "d.body")


@query("txt_r2_document_chunks")
def r2(spark, sf_dir):
    """No SQL: packing depends on all earlier units of a document; held against a brute-force packing in the tests."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.document_chunks(F.col("text"))).alias("chunk", "text"))
    return rows.select("doc_id", "chunk", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


@query("txt_r4_visible_text")
def r4(spark, sf_dir):
    """No SQL: pages are parsed; held against a page of known text in the tests."""
    return read(spark, sf_dir, "pages").select("page_id", X.visible_text(F.col("html").cast("string")).alias("text"))


_FUSED = """with q as (select vec_id as q, embedding as e from embeddings where vec_id < 5), c as (select vec_id, embedding, label from embeddings),
s as (select q, vec_id, sum(round(a * 1000)::bigint * round(b * 1000)::bigint)::bigint as dense, any_value(case when label = 3 then 2 else 0 end + vec_id % 3)::bigint as lexical from (select q, vec_id, label, unnest(embedding)::double as a, unnest(e)::double as b from c, q) group by 1, 2),
m as (select *, min(dense) over w as d0, max(dense) over w as d1, min(lexical) over w as l0, max(lexical) over w as l1 from s window w as (partition by q)),
f as (select q, vec_id, 0.55::double * ((dense - d0)::double / (d1 - d0)::double) + 0.45::double * ((lexical - l0)::double / (l1 - l0)::double) as score from m)
select q, rank, vec_id from (select q, vec_id, row_number() over (partition by q order by score desc, vec_id) as rank from f) where rank <= 4"""


@query("txt_r7_hybrid", _FUSED)
def r7(spark, sf_dir):
    """Five asked vectors (a stated query set) against all rows; whole thousandths, so that both engines agree on ties."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("v"), "label")
    asked = e.where("vec_id < 5").select(F.col("vec_id").alias("q"), F.col("v").alias("w"))
    dense = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
    lexical = F.when(F.col("label") == 3, 2).otherwise(0) + F.col("vec_id") % 3
    s = e.crossJoin(F.broadcast(asked)).select("q", "vec_id", dense.alias("dense"), lexical.alias("lexical"))
    return R.fused(s, ["q"], "dense", "lexical", "vec_id", 4)


@query("txt_r9_index", "select count(*)::bigint as chunks, count(distinct doc_id)::bigint as documents from documents where text is not null and length(text) > 0")
def r9(spark, sf_dir):
    """An index written with its manifest and read again by it; a table that differs from its manifest is refused."""
    at = K.scratch(spark, "index")
    R.write_index(read(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.sha2("text", 256).alias("digest")), at)
    return R.read_index(spark, at).agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"))
