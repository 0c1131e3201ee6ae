"""Scans of text: strict and dirty CSV, logs with a header line of their own, packet fields, JSON objects.

A scan takes lines (``value``, and ``line``, the number of each in its file, where the order matters), so it holds for
files read by ``numbered_lines`` and for lines from anywhere else. What does not parse is a row with a reason, not an
error, unless the scan is strict. Null lines count as empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The packet fields that a capture is decoded to, in order.
PACKET_FIELDS = (
    "frame.number frame.time_epoch frame.len ip.src ipv6.src ip.dst ipv6.dst ip.proto ipv6.nxt"
    " tcp.srcport tcp.dstport udp.srcport udp.dstport tcp.flags"
).split()


def strict_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header that must equal ``schema`` in names and order, and whose values must parse."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """CSV lines as columns; a line that does not fit the schema stops the query."""
    return lines.select(F.from_csv("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: every line of text files with its number from 0, in one more pass over the files and no sort.

    A block of a file is read by one task in order. The lines before a block are the sum of the earlier blocks' counts,
    a row for each block.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at")
    )
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(starts) if starts.count() <= 100_000 else starts, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def unzip(spark: SparkSession, archive: str, member: str, to: str) -> str:
    """Stream one member of a zip archive to a file of the store; nothing of it is held in memory."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(archive), jvm.org.apache.hadoop.fs.Path(to)
    source = jvm.java.util.zip.ZipInputStream(a.getFileSystem(conf).open(a))
    try:
        while (entry := source.getNextEntry()) is not None:
            if entry.getName() == member:
                out = b.getFileSystem(conf).create(b, True)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                out.close()
                return to
    finally:
        source.close()
    raise FileNotFoundError(f"{member} in {archive}")


def required_int(text: Column, least: int = 0) -> Column:
    """The integer that a field must hold, of 18 digits at most, or null."""
    number = F.when(text.rlike(r"^[+-]?\d{1,18}$"), text.cast("long"))
    return F.when(number >= least, number)


def validated(lines: DataFrame, names: list[str], integers: list[str], texts: list[str], order: tuple[str, str]) -> DataFrame:
    """Each line with its digest, its fields, and why it is not valid: ``critical_valid`` and ``reasons`` in fixed order.

    Reasons are a wrong number of fields, an integer field that is none or negative, an empty text field, and times out of order. A
    field that is not an integer counts as 0 in the order of times. Missing fields are empty.
    """
    parts = F.split(F.coalesce("value", F.lit("")), ",", -1)
    rows = lines.select("*", F.sha2(F.coalesce("value", F.lit("")), 256).alias("digest"), parts.alias("_p"))
    rows = rows.withColumns({n: F.coalesce(F.get("_p", F.lit(k)), F.lit("")) for k, n in enumerate(names)})
    numbers = {n: required_int(F.col(n)) for n in integers}
    start, end = (F.coalesce(numbers[n], F.lit(0)) for n in order)
    reasons = [F.when(F.size("_p") != len(names), F.lit("column_count"))]
    reasons += [F.when(numbers[n].isNull(), F.lit(n)) for n in integers] + [F.when(F.col(n) == "", F.lit(n)) for n in texts]
    reasons += [F.when(end < start, F.lit("time_order"))]
    rows = rows.withColumn("reasons", F.array_compact(F.array(*reasons))).drop("_p")
    return rows.withColumn("critical_valid", F.size("reasons") == 0)


def leading_fields(lines: DataFrame, names: list[str], commas: int) -> DataFrame:
    """The first fields of lines whose later ones may hold commas, and whether a line has the usual number of commas."""
    parts = F.split("value", ",", len(names) + 1)
    usual = F.length("value") - F.length(F.replace("value", F.lit(","), F.lit(""))) == commas
    return lines.select(*[F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)], usual.alias("usual"))


def last_two_fields(lines: DataFrame, names: tuple[str, str]) -> DataFrame:
    """The last two comma-separated fields; null for a line with fewer."""
    found = [F.regexp_extract("value", "^(?s)(.*),([^,]*),([^,]*)$", k) for k in (2, 3)]
    fits = F.col("value").rlike("^(?s).*,[^,]*,[^,]*$")
    return lines.select("*", *[F.when(fits, v).alias(n) for v, n in zip(found, names)])


def headed_log(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a log in the latest header of whose lines (``#fields a b ...``) the fields are named; other ``#`` lines are comments.

    ``row`` numbers the rows that are no comments, from 1. A row with another number of fields has ``error`` set and no
    values. The headers, a few lines, are joined by range of lines; numbers of rows are their line less the comments before.
    """
    marks = lines.where(F.col("value").startswith("#") | (F.col("value") == "")).select("line", "value")
    order = Window.orderBy("line")  # over comments and headers alone
    marks = marks.withColumns({"seen": F.row_number().over(order), "until": F.coalesce(F.lead("line").over(order), F.lit(1 << 62))})
    header = F.last(F.when(F.col("value").startswith("#fields"), F.slice(F.split(F.trim("value"), r"\s+"), 2, 10_000)), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marks = marks.withColumn("fields", header)
    first = marks.agg(F.min("line")).select(F.lit(-1).cast("long").alias("m_line"), F.lit(0).alias("seen"), F.coalesce("min(line)", F.lit(1 << 62)).alias("until"), F.lit(None).cast("array<string>").alias("fields"))
    spans = first.unionByName(marks.select(F.col("line").alias("m_line"), "seen", "until", "fields"))
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    rows = rows.join(F.broadcast(spans), (F.col("line") > F.col("m_line")) & (F.col("line") < F.col("until")))
    values = F.split(F.trim("value"), r"\s+")
    names = F.coalesce("fields", F.array().cast("array<string>"))
    fits = F.size(values) == F.size(names)
    of = F.when(fits, F.map_from_arrays(names, values))
    out = [F.try_element_at(of, F.lit(c)).alias(c) for c in columns]
    return rows.select((F.col("line") - F.col("seen") + 1).alias("row"), *out, F.when(~fits, F.lit("field_count_mismatch")).alias("error"))


def first_value(text: Column) -> Column:
    """The first of several comma-separated values."""
    return F.split_part(F.coalesce(text, F.lit("")), F.lit(","), F.lit(1))


def whole_number(text: Column, default: int = 0) -> Column:
    """An integer, decimal, or hexadecimal after ``0x``; ``default`` for anything else."""
    t = F.trim(text)
    hexadecimal = F.when(t.rlike("^0[xX][0-9A-Fa-f]{1,15}$"), F.conv(F.substring(t, 3, 16), 16, 10).cast("long"))
    decimal = F.when(t.rlike(r"^[+-]?\d{1,18}$"), t.cast("long"))
    real = F.when(t.rlike(r"^[+-]?\d{1,15}\.\d*$"), t.cast("double")).cast("long")
    return F.coalesce(hexadecimal, decimal, real, F.lit(default).cast("long"))


def packets(fields: DataFrame) -> DataFrame:
    """Packets from decoded fields (``PACKET_FIELDS`` with ``_`` for ``.``): endpoints, protocols, ports and flags.

    IPv4 comes before IPv6, TCP before UDP before ICMP. Rows without a frame number, a time or both endpoints go.
    """
    f = {n: first_value(F.col(n.replace(".", "_"))) for n in PACKET_FIELDS}
    either = lambda a, b: F.when(f[a] != "", f[a]).otherwise(f[b])
    number = lambda n: whole_number(f[n])
    protocol = whole_number(either("ip.proto", "ipv6.nxt"))
    tcp = (number("tcp.srcport") != 0) | (number("tcp.dstport") != 0) | (protocol == 6)
    udp = (number("udp.srcport") != 0) | (number("udp.dstport") != 0) | (protocol == 17)
    other = F.when(protocol != 0, F.concat(F.lit("IP_"), protocol.cast("string"))).otherwise("IP_OTHER")
    port = lambda a, b: F.when(tcp, number(a)).when(udp, number(b)).otherwise(0)
    out = fields.select(
        whole_number(f["frame.number"], -1).alias("frame"), F.coalesce(F.expr("try_cast(split_part(frame_time_epoch, ',', 1) as double)"), F.lit(-1.0)).alias("time"),
        number("frame.len").alias("length"), either("ip.src", "ipv6.src").alias("src"), either("ip.dst", "ipv6.dst").alias("dst"),
        F.when(f["ip.src"] != "", "IPv4").otherwise("IPv6").alias("l3"),
        F.when(tcp, "TCP").when(udp, "UDP").when(protocol.isin(1, 58), "ICMP").otherwise(other).alias("l4"),
        port("tcp.srcport", "udp.srcport").alias("sport"), port("tcp.dstport", "udp.dstport").alias("dport"), number("tcp.flags").alias("flags"),
    )
    return out.where("frame >= 0 and time >= 0 and src <> '' and dst <> ''")


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """JSON objects, one a line, as columns; blank lines are none, and a line that is no object has ``bad`` set."""
    rows = lines.where(F.trim("value") != "")
    return rows.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*").withColumnRenamed("_bad", "bad")


def bundle_objects(bundles: DataFrame) -> DataFrame:
    """``id, type, external_id, source_ref, target_ref, relation`` of the objects of JSON bundles in ``value``; revoked ones go."""
    ddl = "objects array<struct<id: string, type: string, revoked: boolean, relationship_type: string, source_ref: string, target_ref: string, external_references: array<struct<external_id: string>>>>"
    o = bundles.select(F.explode(F.from_json("value", ddl)["objects"]).alias("o")).where(~F.coalesce(F.col("o.revoked"), F.lit(False)))
    return o.select("o.id", "o.type", F.get("o.external_references.external_id", F.lit(0)).alias("external_id"), "o.source_ref", "o.target_ref", F.col("o.relationship_type").alias("relation"))


def parents(objects: DataFrame) -> DataFrame:
    """``external_id, parent_id``: each pattern's external id and that of the pattern it is a part of, else its own."""
    patterns = objects.where("type = 'attack-pattern' and external_id is not null").select("id", "external_id")
    parts = objects.where("type = 'relationship' and relation = 'subtechnique-of'").select(F.col("source_ref").alias("id"), F.col("target_ref").alias("up"))
    up = patterns.select(F.col("id").alias("up"), F.col("external_id").alias("parent"))
    return patterns.join(parts, "id", "left").join(up, "up", "left").select("external_id", F.coalesce("parent", "external_id").alias("parent_id"))
