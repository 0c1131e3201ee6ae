"""Event queries against their SQL on planted events: what the test tables do not have."""

import random

import duckdb
import pandas as pd

from tidewell import plans
from tidewell.operators import context as C

START = 1_700_000_000_000


def equal(spark, tmp_path, name, rows):
    """The rows of a query over events ``(event_id, ms, user_id, event_type, value)``, which its SQL gives as well."""
    e = pd.DataFrame(rows, columns=["event_id", "ms", "user_id", "event_type", "value"]).astype({"event_id": "Int64", "user_id": "Int64"})
    e["ts"] = pd.to_datetime(e.pop("ms") + START, unit="ms").astype("datetime64[us]")
    e.to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = plans.queries()[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    want = con.execute(f"select {', '.join(cols)} from ({plans.oracle_sql()[name]})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    return [dict(zip(cols, r)) for r in got]


def test_gap_quantiles_round_halves_to_even(spark, tmp_path):
    got = equal(spark, tmp_path, "agg_a13_gap_profile", [(1, 0, 1, "a", 1.0), (2, 2, 1, "a", 1.0), (3, 5, 1, "a", 1.0)])
    assert got[0]["p50"] == 2  # of 2 and 3


def test_evidence_of_a_key_without_values_is_null(spark, tmp_path):
    rows = [(3, 0, 1, "a", 1.0), (6, 1, 1, "b", 1.0), (4, 0, 2, "a", 1.0), (1, 0, 3, "a", 1.0), (12, 0, 4, "a", 1.0)]
    got = {r["src"]: (r["methods"], r["statuses"]) for r in equal(spark, tmp_path, "agg_a24_application_evidence", rows)}
    assert got == {1: ("A B", None), 2: (None, "204"), 3: (None, None), 4: ("A", "212")}


def test_previous_of_ids_from_a_million_on(spark, tmp_path):
    step = 13_000_000  # ids of one port
    rows = [(0, 0, 1, "a", 1.0), (13, 0, 1, "a", 1.0), (step + 26, 5, 1, "a", 1.0), (2 * step, 6, 1, "a", 1.0), (39, 9, 1, "a", 1.0), (52, 40, 1, "a", 1.0)]
    got = {r["flow_id"]: r["previous"] for r in equal(spark, tmp_path, "win_w6_previous_same_pair", rows)}
    assert got[0] is None and got[step + 26] == 13 and got[52] == 0  # the last of 2 * step, which is latest by time and digits


def plan_of(spark, tmp_path, name):
    return plans.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def crowd(n=400):
    """Events close in time, with times in common, ends before starts, and users and values that are null."""
    return [(i, (i * 7919 % n) // 3 * 900_000, None if i % 37 == 5 else i * i % 9, "ab"[i % 2], None if i % 41 == 7 else (-3600.0 if i % 29 == 3 else i % 13 * 1800.0)) for i in range(n)]


def test_all_metrics_of_a_crowd_without_windows(spark, tmp_path):
    got = equal(spark, tmp_path, "win_w7_all_metrics", crowd())
    assert len(got) == 400 and max(r["prior_24h"] for r in got) > 5
    assert plan_of(spark, tmp_path, "win_w7_all_metrics").count("Window") == 0


def test_relation_evidence_of_a_crowd_meets_no_pairs(spark, tmp_path):
    got = equal(spark, tmp_path, "win_w11_relation_evidence", crowd())
    assert max(r["sessions"] for r in got) > 5 and max(r["unexpected"] for r in got) > 0
    assert plan_of(spark, tmp_path, "win_w11_relation_evidence").count("Join ") == 1  # results to rows


def test_recent_context_of_many_groups(spark, monkeypatch):
    rng = random.Random(3)
    some = lambda n: [(rng.randrange(4), rng.randrange(-90, 200), i, rng.randrange(5), rng.choice([None, 1, 2, 3])) for i in range(n)]
    seen, asked = some(500), some(300)
    monkeypatch.setattr(C, "AT_ONCE", 20)
    ddl = "k long, t long, id long, x long, v long"
    df = C.recent_context(spark.createDataFrame(seen, ddl), spark.createDataFrame(asked, ddl), ["k"], ["id"], "t", {"a": 7, "b": 40}, ["x"], ["v"])
    got = {r["id"]: (r["x_a"], r["v_a"], r["x_b"], r["v_b"], r["last"]) for r in df.collect()}
    for k, t, i, *_ in asked:
        near = lambda h: [r for r in seen if r[0] == k and t - h <= r[1] < t]
        want = [w for h in (7, 40) for w in (sum(r[3] for r in near(h)), len({r[4] for r in near(h)} - {None}))]
        assert got[i] == (*want, max((r[1] for r in near(40)), default=None))
