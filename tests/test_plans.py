"""Every registered query against its SQL, and the fixtures' edge cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell import plans
from tidewell.operators import history as H
from tidewell.operators import joins as J
from tidewell.operators import metrics as M
from tidewell.operators import sessions as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df, want = plans.queries()[name](spark, SF), duck.sql(plans.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_strict_past_excludes_peers(spark):
    rows = spark.createDataFrame([(1000, "s", "d1"), (1000, "s", "d2"), (2000, "s", "d3")], "t long, src string, dst string")
    got = rows.select("dst", F.count("*").over(H.past(["src"], "t", 10_000)).alias("n"), H.last_seen_gap(["src"], "t").alias("gap")).collect()
    assert {r["dst"]: (r["n"], r["gap"]) for r in got} == {"d1": (0, -1), "d2": (0, -1), "d3": (2, 1000)}


def test_completed_history_boundaries(spark):
    rows = spark.createDataFrame([(1, 80_000, 89_900), (2, 89_000, 90_000), (3, 80_000, 101_000), (4, 95_000, 100_000), (5, 100_000, 101_000), (6, 100_000, 100_500)], "id int, s long, e long").withColumn("k", F.lit("a"))
    n = lambda h: {r["id"]: r["p_n"] for r in H.completed_history(rows, ["k"], "s", "e", h, {"n": F.lit(1)}, "p").collect()}
    assert n(10_000)[5] == 1 and n(60_000)[5] == 2 and n(10_000)[6] == 1


def test_delta_equals_frames(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("k"), F.floor(F.col("id") * 7919 % 1000 / 10).alias("t"), (F.col("id") % 17).alias("v"))
    w = H.past(["k"], "t", 20)
    want = rows.select("id", F.count("*").over(w).alias("p_count"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("p_sum"))
    got = H.delta_history(rows, ["k"], "t", 20, "v", "p").select("id", "p_count", "p_sum")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_gap_groups_follow_the_order_of_rows(spark):
    rows = spark.createDataFrame([(0, 0, 1, 2, "B"), (1, 1000, 1, 2, "B"), (2, 12000, 1, 2, "S"), (3, 13000, 2, 1, "S")], "o long, t long, a long, b long, label string").select("*", *S.unordered("a", "b"))
    count = lambda keys: S.gap_groups(rows, keys, "t", "o", 5000).select(*keys, "episode").distinct().count()
    assert count(["a", "b"]) == 3 and count(["low", "high"]) == 2


def test_a_gap_of_exactly_the_timeout_does_not_split(spark):
    rows = spark.createDataFrame([(1, 0, 0), (2, 60, 60), (3, 121, 121)], "id long, s long, e long").withColumn("k", F.lit(1))
    assert [r["session"] for r in S.sessionize(rows, ["k"], "s", "e", 60, "id").orderBy("id").collect()] == [0, 0, 1]


def test_chronological_quarantine(spark):
    rows = spark.createDataFrame([(0.0, 60.0), (66.0, 72.0), (76.0, 79.0), (91.0, 95.0)], "s double, e double")
    got = [r[0] for r in rows.select(S.chronological_split("s", "e", F.lit(0.0), F.lit(100.0), 10)).collect()]
    assert got == ["train", "quarantine", "validation", "test"]


EVENT = ("e1", 1000, 5000, "x", "y", 80, "Scan")


@pytest.mark.parametrize(
    ("flow", "events", "want"),
    [
        (("f", 2000, 2100, "x", "y", 80, "Scan"), [EVENT], ("unique", "e1", "exact_tuple_time", True)),
        (("f", 6000, 6100, "x", "y", 80, "Scan"), [EVENT], ("unmatched", None, None, None)),
        (("f", 2000, 2100, "y", "x", 80, "Scan"), [EVENT], ("unique", "e1", "reverse_direction_time", True)),
        (("f", 2000, 2100, "x", "y", 22, "Scan"), [("e1", 1000, 5000, "x", "y", None, "Scan")], ("unique", "e1", "wildcard_port_time", True)),
        (("f", 2000, 2100, "x", "y", 80, "Scan"), [("e2", *EVENT[1:]), EVENT], ("ambiguous", "e1,e2", None, None)),
        (("f", 2000, 2100, "x", "y", 80, "Other"), [EVENT], ("unique", "e1", "exact_tuple_time", False)),
        (("f", 86_399_000, 86_402_000, "x", "y", 80, "Scan"), [("e1", 86_401_000, 86_405_000, "x", "y", 80, "Scan")], ("unmatched", None, None, None)),
    ],
)
def test_event_match(spark, flow, events, want):
    f = spark.createDataFrame([flow], "flow_id string, start_ms long, end_ms long, src string, dst string, dport int, label string")
    e = spark.createDataFrame(events, "event_id string, start_ms long, end_ms long, src string, dst string, dport int, label string")
    assert tuple(J.match_events(f, e).first())[1:] == want


def test_auroc_and_wilson(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (0, False), (2, True)], "s int, p boolean")
    assert tuple(M.auroc_counts(rows, "s", "p").first()) == (2, 2, 7)
    low, high = spark.range(1).select(*M.wilson(F.lit(5), F.lit(10))).first()
    assert low == pytest.approx(0.2366, abs=1e-4) and high == pytest.approx(0.7634, abs=1e-4)
