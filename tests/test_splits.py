"""Splits and samplers without SQL, against plain loops; running totals by range against one window."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import splits as P


def side(start, end, a, b, gap):
    if end <= a - gap / 2:
        return "train"
    if start >= a + gap / 2 and end <= b - gap / 2:
        return "validation"
    return "test" if start >= b + gap / 2 else "quarantine"


@pytest.mark.parametrize("n", [1, 7, 60, 700])
def test_boundary_search_equals_a_plain_loop(n):
    r = random.Random(n)
    rows = sorted((float(s := r.randrange(5000)), float(s + r.randrange(40)), f"e{r.randrange(200)}", f"n{r.randrange(60)}") for _ in range(n))
    starts, found = [x[0] for x in rows], []
    tier = lambda c: 3 if c >= 100 else 2 if c >= 30 else 1 if c else 0
    for p in range(50, 81):
        for q in range(max(p + 8, 75), 96):
            a, b = starts[min(n - 1, int(n * (p / 100)))], starts[min(n - 1, int(n * (q / 100)))]
            of = [side(s, e, a, b, 5.0) for s, e, _, _ in rows]
            c = {k: of.count(k) for k in ("train", "validation", "test", "quarantine")}
            off = abs(c["train"] / n - 0.70) + abs(c["validation"] / n - 0.15) + abs(c["test"] / n - 0.15)
            v, t = tier(c["validation"]), tier(c["test"])
            found.append(((min(v, t), v + t, int(c["train"] >= 100), -off, -c["quarantine"]), a, b, p / 100, q / 100, of))
    found.sort(key=lambda x: x[:5], reverse=True)
    best = None
    for s, a, b, p, q, of in found[:80]:
        kinds = [{x[k] for x, o in zip(rows, of) if o == "train"} for k in (2, 3)]
        every = [{x[k] for x in rows} for k in (2, 3)]
        again = (s[:3], sum(len(k) >= 30 or len(e) < 30 for k, e in zip(kinds, every)), sum(min(len(k), 30) for k in kinds), s[3], s[4])
        if best is None or again > best[0]:
            best = (again, a, b, p, q)
    assert P.best_boundary(pd.DataFrame(rows, columns=["start", "end", "exact", "near"]), 5.0) == best[1:]


def test_large_captures_are_not_searched(spark):
    rows = spark.range(50).selectExpr("id % 2 + if(id < 40, 0, 1) * 0 as capture", "id * 10 as start", "id * 10 + 1 as end", "'x' as exact", "'y' as near")
    assert P.boundaries(rows, "capture", 0.0, most=24).count() == 0 and P.boundaries(rows, "capture", 0.0).count() == 2


def test_balanced_bins_equal_a_plain_loop(spark):
    r = random.Random(2)
    rows = [(k, f"g{r.randrange(30)}", r.choice("ab"), r.randrange(100)) for k in range(400)]
    groups = {}
    for k, g, y, t in sorted(rows, key=lambda x: (x[3], x[0])):
        groups.setdefault(g, [y, t, 0])[2] += 1
    want = {}
    for y in "ab":
        held = [0, 0]
        for g, (_, _, n) in sorted(((g, v) for g, v in groups.items() if v[0] == y), key=lambda x: (x[1][1], x[0])):
            want[g] = held.index(min(held))
            held[want[g]] += n
    got = P.balanced_bins(spark.createDataFrame(rows, "k int, g string, y string, t int"), ["y"], "g", "t", "k").collect()
    assert {x["g"]: x["bin"] for x in got} == want


def test_support_and_query_keep_their_rules(spark):
    r = random.Random(3)
    rows = [(k, r.choice("ab"), f"e{r.randrange(80)}", f"r{r.randrange(40)}", f"n{r.randrange(9)}") for k in range(300)]
    of = {x[0]: x for x in rows}
    got = P.support_and_query(spark.createDataFrame(rows, "id int, y string, e string, r string, n string"), "y", "id", ["e", "r", "n"], "s", 12, 10).collect()
    for y in "ab":
        support, query = ([of[g["id"]] for g in sorted(got, key=lambda g: g["rank"]) if (g["y"], g["role"]) == (y, k)] for k in ("support", "query"))
        assert len(support) == 12 and len(query) == 10
        assert all(len({x[k] for x in (*support, *query)}) == 22 for k in (2, 3))
        distinct = len({x[4] for x in support})
        assert distinct >= 6 and len({x[4] for x in support[:distinct]}) == distinct  # the near-distinct ones come first


def test_group_search_meets_the_least_counts():
    r = random.Random(4)
    members = {f"g{k}": {x for x in "abc" if r.random() < 0.7} for k in range(40)}
    lack, parts = P.group_split_search(members, list("abc"), (28, 6, 6), (5, 2, 2), 1, 5000)
    assert lack == 0 and [len(p) for p in parts.values()] == [28, 6, 6] and len({g for p in parts.values() for g in p}) == 40
    assert all(sum(x in members[g] for g in parts[k]) >= n for x in "abc" for k, n in ((0, 5), (1, 2), (2, 2)))


def plain_actions(rows, budget):
    out = {}
    for k, t, r, tr in sorted((x for x in rows if max(x[1:]) > 0), key=lambda x: (-max(x[1:]), x[0])):
        u = dict(T=t, R=r, TR=tr)
        wish = next(f for f in ("T", "R", "TR") if u[f] == max(u.values()))
        cost = 2 if wish == "TR" else 1
        if cost <= budget:
            out[k] = wish
            budget -= cost
        elif budget:
            if one := next((f for f in ("T", "R") if u[f] > 0), None):
                out[k] = one
                budget -= 1
        if not budget:
            break
    return out


@pytest.mark.parametrize("budget", [0, 1, 2, 31, 32, 33, 1000])
def test_budgeted_actions_equal_a_plain_loop(spark, budget):
    r = random.Random(budget)
    rows = [(k, *(r.randint(-6, 9) for _ in range(3))) for k in range(120)]
    got = P.typed_actions(spark.createDataFrame(rows, "k long, u_t long, u_r long, u_tr long"), budget, "k").collect()
    assert {x["k"]: x["action"] for x in got} == plain_actions(rows, budget)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_by_range_equal_one_window(spark, descending):
    rows = spark.range(1000).selectExpr("id", "id * 7919 % 250 as k", "id % 13 as v").repartition(7)
    order = [F.desc("k") if descending else F.asc("k"), F.asc("id")]
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = {x["id"]: x["b"] for x in rows.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("b")).collect()}
    got = P.running_by_range(rows, "k", {"b": "v"}, cuts=16, descending=descending, tie="id").collect()
    assert {x["id"]: x["b"] for x in got} == want
    assert P.running_by_range(rows.where("id < 0"), "k", {"b": "v"}, tie="id").count() == 0
