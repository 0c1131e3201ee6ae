"""Statistics without SQL, and those with a plain definition, against numpy; text functions against known texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import texts as X
from tidewell.functions import validation as V
from tidewell.operators import metrics as M
from tidewell.operators import splits as P
from tidewell.sources import captures, scans, sinks


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 90, 500))]
    df = spark.createDataFrame(rows, "g int, v double")
    at = {"a": 0.0, "b": 0.333, "c": 0.5, "d": 0.999, "e": 1.0}
    for r in P.quantiles(df, "v", at, ["g"]).collect():
        want = np.quantile([v for g, v in rows if g == r["g"]], list(at.values()))
        assert [r[k] for k in at] == pytest.approx(want.tolist())
    whole = P.quantiles(df, "v", at).first()
    assert [whole[k] for k in at] == pytest.approx(np.quantile([v for _, v in rows], list(at.values())).tolist()) and whole["n"] == 500


def test_mahalanobis_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)) + 3 * k for k in range(3)])
    rows = [(i, int(i // 60), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>")
    fitted = M.geometry(df, "y", "v")
    centred = x - x.mean(0)
    cov = centred.T @ centred / len(x)
    mu = np.trace(cov) / 4
    delta = ((cov - mu * np.eye(4)) ** 2).sum() / 4
    beta = min(sum(((np.outer(c, c) - cov) ** 2).sum() for c in centred) / len(x) ** 2 / 4, delta)
    inverse = np.linalg.pinv((1 - beta / delta) * cov + beta / delta * mu * np.eye(4))
    assert np.array(fitted[2]) == pytest.approx(inverse, rel=1e-6)
    means = np.stack([x[60 * k : 60 * k + 60].mean(0) for k in range(3)])
    d = np.sqrt(np.einsum("nkd,de,nke->nk", x[:, None] - means, inverse, x[:, None] - means))
    got = {r["id"]: r for r in M.nearest_class(df, "id", "v", fitted).collect()}
    assert [got[i]["distance"] for i in range(180)] == pytest.approx(d.min(1).tolist(), rel=1e-5)
    assert [got[i]["label"] for i in range(180)] == [str(k) for k in d.argmin(1)]


def test_ranks_and_precision(spark):
    rows = spark.createDataFrame([(3, True, 1), (2, False, 2), (2, True, 1), (1, True, 3), (0, False, 1)], "s int, p boolean, w int")
    assert M.average_precision(rows, "s", "p").first()[0] == pytest.approx(1 / 3 + 2 / 3 / 3 + 3 / 4 / 3)
    assert M.fpr_at_tpr(rows, "s", "p", 0.6).first()[0] == 0.5 and M.fpr_at_tpr(rows.where("not p"), "s", "p", 0.6).first()[0] == 1.0
    assert tuple(M.auroc_counts(rows, "s", "p", "w").first()) == (5, 3, 2 * 3 + (2 * 1 + 2) + 2 * 3)
    ranks = {(r["s"]): r["r"] for r in M.weighted_ranks(rows, "s", "w", "r").collect()}
    assert ranks == {0: 1.0, 1: 3.0, 2: 6.0, 3: 8.0}


def one(spark, column, text, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("GET /a/12/x.php?id=5&cmd=ls HTTP/1.1\r\nHost: h.example\r\nCookie: a=b\r\nX-Y: z\r\n\r\nuser=bob", "GET /<SEG>/<NUM>/<FILE>.php?<QUERY_PARAM>=<NUM>&<COMMAND_PARAM>=<TEXT> HTTP/1.1\nHost: <HOST>\nCookie: <SECRET>\n\n<CREDENTIAL_PARAM>=bob"),
        ("HTTP/1.1 200 OK\n\nx", None),
        ("from 10.0.0.1 by nmap, Mon, 01 Jan 2024 030405 GMT", "from <IP> by <AUTOMATION_TOOL>, <TIME>"),
        ("id 123e4567-e89b-12d3-a456-426614174000 and 0123456789abcdef0123456789abcdef", "id <UUID> and <TOKEN>"),
        ('x; filename="run me.exe"', 'x; <FILE_PARAM>="<FILE>.exe"'),
        ("a=1&upload=x", "<PARAM>=1&<FILE_PARAM>=x"),
        ("&lt;b&gt;  c", "<b> c"),
        (" \x01 ", None),
        (None, None),
    ],
)
def test_masks(spark, text, want):
    assert one(spark, X.masked, text) == want


def test_masking_leaves_no_identity(spark):
    text = "token=abc 192.168.0.77 sqlmap/1.2 fe80::1:2:3 /var/www/x?y E404 " + "z" * 40
    out = one(spark, X.masked, text)
    assert out == one(spark, X.masked, out) and not any(w in out for w in ("192.168", "sqlmap", "fe80", "var/www", "zzzz", "abc"))


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"b": 1, "a": 2}', '{"a":2,"b":1}'), ('```json\n[1, 2]\n```', "[1,2]"), ("<think>{}</think> so {\"x\": [1]} it is", '{"x":[1]}'), ('{"a":1} {"b":2}', None), ("none", None), ("", None)],
)
def test_json_values(spark, text, want):
    assert one(spark, X.json_value, text) == want


def test_tolerant_objects(spark):
    assert one(spark, X.tolerant_object, "```json\n{\"a\": 1}\n```") == '{"a":1}'
    assert one(spark, X.tolerant_object, "well {\"a\": {\"b\": 2}} done") == '{"a":{"b":2}}' and one(spark, X.tolerant_object, "[1]") is None


def test_visible_text(spark):
    page = "<html><head><style>x{}</style></head><body><h1>Title</h1><nav>menu</nav><p>One   two</p><script>no()</script><ul><li>three</li></ul></body></html>"
    assert one(spark, X.visible_text, page).split() == ["Title", "One", "two", "three"]
    assert one(spark, X.visible_text, "plain  text\n \n\nmore") == "plain text\n\nmore"


def test_chunks():
    body = "# A\n" + "word " * 30 + "\n\n" + "\n".join(["line one", "line two"]) + "\n# B\n" + "x" * 500 + "\n\nend"
    assert X.units(body) == ["# A", ("word " * 30).strip(), "line one\nline two", "# B", "x" * 500, "end"]
    out = X.chunks(body, 200, 100)
    assert out[0] == "# A\n\n" + ("word " * 30).strip() and "".join("".join(out).split()) == "".join(body.split())
    assert all(len(c) <= 200 or c == "x" * 500 for c in out)
    assert X.chunks("") == [] and X.pieces("aa bb cc", 5) == ["aa bb", "cc"]


def test_hex_text(spark):
    assert one(spark, X.hex_text, "48:65:6c 6c6f") == "Hello"
    assert [one(spark, X.hex_text, x) for x in ("", "4", "0001020304", None)] == [None] * 4


def test_forbidden_keys(spark):
    value = '{"a": {"LABEL": 1, "b": [{"src_ip": 2}, 3]}, "label": {"label": 4}}'
    assert one(spark, lambda c: V.forbidden_keys(c, {"label", "src_ip"}), value) == ["a.LABEL", "a.b[0].src_ip", "label", "label.label"]
    assert one(spark, lambda c: V.forbidden_keys(c, {"label"}), "no json") == []


def test_a_forbidden_role_stops_the_query(spark):
    rows = spark.createDataFrame([("a",), ("u",)], "role string")
    assert V.authorised(rows, "role", ["x"]).count() == 2
    with pytest.raises(Exception, match="isolated role"):
        V.authorised(rows, "role", ["u"]).collect()
    with pytest.raises(ValueError):
        V.features(rows.withColumn("label", F.lit(1)), {"label": "model_feature"})


def test_numbered_lines_and_zip(spark, tmp_path):
    import zipfile

    lines = [f"line {k} " + "x" * (k % 50) for k in range(5000)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("other.csv", "no")
        z.writestr("in/data.csv", "\n".join(lines))
    at = scans.unzip(spark, str(tmp_path / "a.zip"), "in/data.csv", str(tmp_path / "data.csv"))
    with pytest.raises(FileNotFoundError):
        scans.unzip(spark, str(tmp_path / "a.zip"), "none", str(tmp_path / "x"))
    small, least = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = scans.numbered_lines(spark, at)
        assert {r["line"]: r["value"] for r in rows.collect()} == dict(enumerate(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
        spark.conf.set("spark.sql.files.openCostInBytes", least)


def test_strict_csv(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,y\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert scans.strict_csv(spark, str(tmp_path / "x.csv"), schema).count() == 2
    with pytest.raises(Exception):
        scans.strict_csv(spark, str(tmp_path / "x.csv"), T.StructType(schema.fields[::-1])).collect()


def test_logs_with_two_headers(spark):
    text = ["#separator x", "#fields\ta\tb", "1\t2", "bad", "#fields\tb", "7", "", "8"]
    lines = spark.createDataFrame(list(enumerate(text)), "line long, value string")
    got = sorted(map(tuple, scans.headed_log(lines, ["a", "b"]).collect()))
    assert got == [(1, "1", "2", None), (2, None, None, "field_count_mismatch"), (3, None, "7", None), (4, None, "8", None)]


def test_logical_hash_ignores_order_and_files(spark, tmp_path):
    rows = spark.range(300).selectExpr("id % 100 as a", "string(id % 7) as b")
    one = tuple(sinks.logical_hash(rows.repartition(1)).first())
    assert one == tuple(sinks.logical_hash(rows.orderBy(F.desc("a")).repartition(5)).first()) and one[0] == 300
    assert one[1] != sinks.logical_hash(rows.limit(299)).first()[1]
    sinks.write_shards(rows.where("a < 0"), str(tmp_path / "none"), [])
    assert (tmp_path / "none" / "_EMPTY.json").exists()
    with pytest.raises(ValueError):
        sinks.partition_path("root", split="../x")


def test_captures_cut_short_end_there():
    import struct

    frame = bytes(12) + b"\x08\x00" + bytes.fromhex("45000028000000004011000001020304" + "05060708" + "1f900035")
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    raw = head + struct.pack("<IIII", 7, 9, len(frame), 99) + frame
    got = list(captures.records(raw + struct.pack("<IIII", 8, 0, 100, 100) + b"torn"))
    assert len(got) == 1 and got[0] == {"frame_number": "1", "frame_time_epoch": "7.000009000", "frame_len": "99", "ip_src": "1.2.3.4", "ip_dst": "5.6.7.8", "ip_proto": "17", "udp_srcport": "8080", "udp_dstport": "53"}
    with pytest.raises(ValueError):
        list(captures.records(b"none"))
