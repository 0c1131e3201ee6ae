"""Streams against the batch result, contracts, bounded fetches, fitted forests."""

import http.server
import threading

import pytest
from pyspark.sql import functions as F

from tidewell.operators import models
from tidewell.sources import contracts
from tidewell.streaming import flows as S

BASE = 10**6
DDL = "id long, k string, t timestamp, size long"


def rows(spark):
    at = [0, 20, 70, 200, 230, 500, 3000]
    data = [(n, *x) for n, x in enumerate((k, BASE + s, s + 1) for k in "ab" for s in at)]
    return spark.createDataFrame(data, "id long, k string, s long, size long").select("id", "k", F.timestamp_seconds("s").alias("t"), "size")


def test_stream_sessions_equal_batch_sessions(spark, tmp_path):
    rows(spark).orderBy("t").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.read_flows(spark, str(tmp_path / "in"), DDL)
    S.run(S.idle_sessions(stream, ["k"], "t", "60 seconds", "1 hour", "size"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r["k"], r["start"].timestamp(), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} if any((tmp_path / "out").glob("*.parquet")) else set()
    want = {(k, BASE + s, n) for k in "ab" for s, n in ((0, 3), (200, 2), (500, 1), (3000, 1))}
    assert got <= want  # only what the watermark has passed is final
    rows(spark).select((F.col("id") + 100).alias("id"), "k", (F.col("t") + F.expr("interval 1 day")).alias("t"), "size").limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    S.run(S.idle_sessions(S.read_flows(spark, str(tmp_path / "in"), DDL), ["k"], "t", "60 seconds", "1 hour", "size"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r["k"], r["start"].timestamp(), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_stream_takes_each_row_once(spark, tmp_path):
    r = rows(spark)
    r.union(r).write.parquet(str(tmp_path / "in"))
    seen = []
    S.run(S.once(S.read_flows(spark, str(tmp_path / "in"), DDL), "id", "t", "1 hour"), "", str(tmp_path / "ck"), lambda b, _: seen.extend(x["id"] for x in b.collect()))
    assert sorted(seen) == list(range(14))


def test_contract(spark):
    text = '{"fields": [{"name": "a", "dtype": "bigint", "role": "model_feature"}, {"name": "y", "dtype": "string", "role": "label"}]}'
    schema = contracts.schema_of(contracts.parse_document(text))
    assert contracts.roles_of(schema) == {"a": "model_feature", "y": "label"}
    contracts.check_schema(spark.createDataFrame([], "a bigint, y string").schema, schema)
    with pytest.raises(ValueError):
        contracts.check_schema(spark.createDataFrame([], "y string, a bigint").schema, schema)
    with pytest.raises(ValueError):
        contracts.schema_of({"fields": [{"name": "a", "dtype": "int"}] * 2})


def test_fetch_is_bounded_and_tries_again():
    answers = [500, 200, 200]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(answers.pop(0))
            self.end_headers()
            self.wfile.write(b"x" * 100)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/"
        assert contracts.fetch(url, 100, wait=0.01) == b"x" * 100
        with pytest.raises(ValueError):
            contracts.fetch(url, 99)
    finally:
        server.shutdown()


def test_forest_learns(spark):
    r = spark.range(600).selectExpr("id % 20 as a", "id % 7 as b", "if(id % 20 < 10, 'x', 'y') as y")
    out = models.classify(models.fit_forest(r, ["a", "b"], "y", 5, 3), r, ["a", "b"])
    assert out.where("y = predicted").count() == 600 and out.agg(F.min("confidence")).first()[0] > 0.5
