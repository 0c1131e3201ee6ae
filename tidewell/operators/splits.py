"""Splits and samplers: boundaries of a timeline, groups kept whole, quotas, round robins, budgets, running totals by range.

A sampler's rule that looks at what it has chosen so far runs once for each stratum, on the bounded candidates of that
stratum; all others are windows. Ties always end in an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least counts of the support tiers, and the grid of boundary anchors in percent.
TIERS = (1, 30, 100)
GRID = [(a, b) for a in range(50, 81) for b in range(max(a + 8, 75), 96)]
SHARES = (0.70, 0.15, 0.15)
RERANKED = 80


def running_by_range(rows: DataFrame, key: str, sums: dict[str, str], cuts: int = 256, descending: bool = False, tie: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """``rows`` with, for each ``name: column`` of ``sums``, the sum of the column over all rows before, in order of ``key``.

    Rows fall into ranges of the key, about equally filled; a window sums within a range, and the ranges' totals, a row
    for each, are summed across. So no task orders the whole table, nor a whole group of ``groups``, within which the sums run
    if it is given. Rows of one key are in one range.
    """
    ends = rows.select(F.percentile_approx(key, [k / cuts for k in range(1, cuts)], 20 * cuts)).first()[0] or []
    by = groups or []
    edges = F.array(*[F.lit(e) for e in sorted(set(ends))]) if ends else F.array().cast("array<double>")
    held = rows.withColumn("_range", F.size(F.filter(edges, lambda e: e < F.col(key))))
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    order = [way(key), *([F.asc(tie)] if tie else [])]
    near = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_o_{n}") for n in sums])
    # null-safe: an equality would let the optimizer infer a filter on the range's expression beyond the aggregate
    offsets = offsets.withColumnsRenamed({c: f"_j_{c}" for c in [*by, "_range"]})
    on = F.lit(True)
    for c in [*by, "_range"]:
        on = on & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    joined = held.join(offsets if by else F.broadcast(offsets), on).drop(*[f"_j_{c}" for c in [*by, "_range"]])
    return joined.withColumns({n: F.coalesce(F.sum(c).over(near), F.lit(0)) + F.col(f"_o_{n}") for n, c in sums.items()}).drop("_range", *[f"_o_{n}" for n in sums])


def quantiles(rows: DataFrame, value: str, at: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """A row, or one for each group: ``n`` and the quantiles of a column, interpolated between the two nearest ranks.

    Ranks come from the counts of distinct values by range, so no task holds a group's values. Nulls are left out.
    """
    by = groups or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    run = running_by_range(counts, "_v", {"_before": "_c"}, groups=groups)
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("n"))
    held = run.join(F.broadcast(sizes), by) if by else run.crossJoin(F.broadcast(sizes))
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    ranked = lambda r: F.max(F.when((F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")), F.col("_v").cast("double")))
    ends = [e for k, q in at.items() for e in (ranked(F.floor(place(q))).alias(f"_l_{k}"), ranked(F.ceil(place(q))).alias(f"_h_{k}"))]
    out = held.groupBy(*by).agg(F.max("n").alias("n"), *ends)
    between = lambda k, q: F.col(f"_l_{k}") + (F.col(f"_h_{k}") - F.col(f"_l_{k}")) * (place(q) - F.floor(place(q)))
    return out.select(*by, "n", *[between(k, q).alias(k) for k, q in at.items()])


def sides(start: np.ndarray, end: np.ndarray, first: np.ndarray, second: np.ndarray, embargo: float) -> Iterator[np.ndarray]:
    """For each pair of boundaries which sessions are in training, validation and test; the others are in quarantine."""
    for a, b in zip(first, second):
        yield np.stack([end <= a - embargo / 2, (start >= a + embargo / 2) & (end <= b - embargo / 2), start >= b + embargo / 2])


def best_boundary(rows: pd.DataFrame, embargo: float) -> tuple[float, float, float, float]:
    """Two boundaries of a capture's sessions ``start, end, exact, near`` and the shares of sessions at which they lie.

    Of all anchors on the grid, those with the best evaluation support come first, then training support, then shares near
    70/15/15, then few in quarantine, then the later anchors. The first 80 are ranked anew with the distinct signatures
    in training (up to 30 count) before the shares.
    """
    rows = rows.sort_values(["start", "end", "exact", "near"], kind="stable")
    start, end = rows["start"].to_numpy(), rows["end"].to_numpy()
    exact, near = (pd.factorize(rows[c])[0] for c in ("exact", "near"))
    n = len(rows)
    at = lambda share: start[min(n - 1, int(n * share))]
    shares = [(a / 100.0, b / 100.0) for a, b in GRID]
    first, second = np.array([at(a) for a, _ in shares]), np.array([at(b) for _, b in shares])
    ranked = []
    for k, inside in enumerate(sides(start, end, first, second, embargo)):
        counts = inside.sum(1).tolist()
        tiers = [sum(c >= t for t in TIERS) for c in counts[1:]]
        away = sum(abs(c / n - s) for c, s in zip(counts, SHARES))
        # what two sides share is in the first, so what is left is in quarantine
        left = n - int(inside.any(0).sum())
        ranked.append(((min(tiers), sum(tiers), int(counts[0] >= 100), -away, -left), first[k], second[k], *shares[k], inside[0]))
    ranked.sort(key=lambda r: r[:5], reverse=True)
    few = [int(len(np.unique(x)) < 30) for x in (exact, near)]
    best = None
    for score, a, b, p, q, train in ranked[:RERANKED]:
        kinds = [len(np.unique(x[train])) for x in (exact, near)]
        again = (score[:3], sum(int(c >= 30 or f) for c, f in zip(kinds, few)), sum(min(c, 30) for c in kinds), *score[3:])
        if best is None or again > best[0]:
            best = (again, float(a), float(b), p, q)
    return best[1:]


def boundaries(rows: DataFrame, capture: str, embargo: float = 5.0, most: int = 20_000) -> DataFrame:
    """``capture, first, second, first_share, second_share`` by search, of captures of at most ``most`` sessions.

    Larger captures take boundaries by rank: a search of the grid is for small ones, and no task gets a large one.
    """
    small = rows.groupBy(capture).count().where(F.col("count") <= most).select(capture)

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *best_boundary(frame, embargo)]], columns=["capture", "first", "second", "first_share", "second_share"])

    kind = dict(rows.dtypes)[capture]
    held = rows.join(small, capture).select(F.col(capture).alias("capture"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "exact", "near")
    return held.groupBy("capture").applyInPandas(search, f"capture {kind}, first double, second double, first_share double, second_share double")


def balanced_bins(rows: DataFrame, strata: list[str], group: str, order: str, tie: str, bins: int = 2) -> DataFrame:
    """``group, bin``: groups stay whole; within a stratum, in order of a group's first row, each goes to the emptiest bin.

    A group's stratum is that of its first row (least ``order``, then ``tie``). Groups are counted before; a stratum's
    groups are one task's, two numbers each.
    """
    groups = rows.groupBy(group).agg(F.min_by(F.struct(*strata), F.struct(order, tie)).alias("s"), F.min(order).alias("first"), F.count("*").alias("n")).select(group, "s.*", "first", "n")
    kind = dict(rows.dtypes)[group]

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["first", group], kind="stable")
        held, out = [0] * bins, []
        for n in frame["n"].tolist():
            out.append(held.index(min(held)))
            held[out[-1]] += n
        return pd.DataFrame({group: frame[group], "bin": np.array(out, "int32")})

    return groups.groupBy(*strata).applyInPandas(place, f"{group} {kind}, bin int")


def early_groups(rows: DataFrame, label: str, group: str, seed: str, share: float = 0.10) -> DataFrame:
    """``label, group, early``: within a label, groups in order of a seeded digest are held back until they have the share of its rows."""
    counts = rows.groupBy(label, group).agg(F.count("*").alias("n"))
    w = Window.partitionBy(label)
    order = F.sha2(F.concat(F.lit(seed), F.col(group).cast("string")), 256)
    before = F.coalesce(F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("early", before < F.bround(F.sum("n").over(w) * F.lit(share).cast("decimal(10,4)"), 0)).select(label, group, "early")


def group_split_search(members: dict[str, set[str]], labels: list[str], sizes: tuple[int, ...], least: tuple[int, ...], seed: int, trials: int = 200_000) -> tuple[int, dict]:
    """A random split of some groups into parts of given sizes in which each label is in at least so many groups of each part.

    A search by trial over a few hundred groups, on the driver; returns the shortfall (0: none) and the parts.
    """
    names = sorted(members)
    has = np.array([[label in members[g] for label in labels] for g in names], np.int16)
    cuts, rng, best = np.cumsum(sizes)[:-1], np.random.default_rng(seed), None
    for _ in range(trials):
        parts = np.split(rng.permutation(len(names)), cuts)
        counts = np.stack([has[p].sum(0) for p in parts])
        lack = int(np.maximum(np.array(least)[:, None] - counts, 0).sum())
        score = (lack, -int(counts.min(initial=0)), -int(counts[1:].min(initial=0)))
        if best is None or score < best[0]:
            best = (score, parts)
        if not lack:
            break
    return best[0][0], {k: [names[i] for i in p] for k, p in enumerate(best[1])}


def support_and_query(rows: DataFrame, label: str, key: str, signatures: list[str], seed: str, shots: int, queries: int) -> DataFrame:
    """``label, key, role, rank``: few-shot support and query rows of each label, in order of a seeded digest.

    The first row of each exact signature stands for it. Support is filled with rows that share no signature, then, if
    they do not suffice, with rows that share only the last (near) one; queries likewise, never sharing an exact or reverse
    signature with support. A label's candidates are cut to ``queries + 20 * shots + 2000``.
    """
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    exact = Window.partitionBy(label, signatures[0]).orderBy("_o", key)
    ranked = Window.partitionBy(label).orderBy("_o", key)
    rows = rows.select(label, key, *signatures).withColumn("_o", order).withColumn("_r", F.row_number().over(exact)).where("_r = 1")
    rows = rows.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= queries + 20 * shots + 2000).drop("_o")
    kinds = dict(rows.dtypes)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        items = frame.sort_values("_r")[[key, *signatures]].values.tolist()
        hard, every = range(1, len(signatures)), range(1, len(signatures) + 1)
        out, banned = [], [set() for _ in range(len(signatures) + 1)]
        for role, most in (("support", shots), ("query", queries)):
            used, chosen = [set(b) for b in banned], set()
            for strict in (every, hard):  # near signatures are a preference, the others a rule
                for item in items:
                    if len(chosen) < most and item[0] not in chosen and item[0] not in banned[0] and not any(item[k] in used[k] for k in strict):
                        chosen.add(item[0])
                        out.append((frame[label].iloc[0], item[0], role, len(chosen)))
                        for k in every:
                            used[k].add(item[k])
            banned = [banned[0] | chosen, *used[1:]]
        return pd.DataFrame(out, columns=[label, key, "role", "rank"])

    return rows.groupBy(label).applyInPandas(choose, f"{label} {kinds[label]}, {key} {kinds[key]}, role string, rank int")


def round_robin(rows: DataFrame, strata: list[str], order: list[Column], target: int) -> DataFrame:
    """``target`` rows, one of each stratum in turn; strata in their order, each stratum's rows in theirs."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return rows.withColumn("_turn", turn).where(F.col("_turn") <= target).orderBy("_turn", *strata).limit(target).drop("_turn")


def quotas(rows: DataFrame, label: str, kind: str, order: Column, total: int, most: dict[str, int], fill: list[str]) -> DataFrame:
    """``total`` rows of each label: up to ``most`` of each named kind, then what lacks, of the kinds of ``fill`` in turn."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(label, kind).orderBy(order))).where(F.col("_k") <= total)
    limit = F.coalesce(*[F.when((F.col(kind) == k) & (F.col("_k") <= n), 0) for k, n in most.items()], *[F.when(F.col(kind) == k, 1 + j) for j, k in enumerate(fill)])
    w = Window.partitionBy(label).orderBy("_s", "_k", kind)
    return ranked.withColumn("_s", limit).where("_s is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= total).drop("_k", "_s", "_r")


def typed_actions(rows: DataFrame, budget: int, key: str, t: str = "u_t", r: str = "u_r", tr: str = "u_tr") -> DataFrame:
    """``key, action``: rows of positive utility, the greatest first, take their best action (T and R cost 1, TR 2) while the budget lasts.

    A row whose best action is too dear takes T or R if that is of use. While two units are left every row takes its best
    action, so its cost is a running total; at most one unit is left then, and the first later row with a use for it takes it.
    """
    best = F.greatest(t, r, tr)
    wish = F.when(F.col(t) == best, "T").when(F.col(r) == best, "R").otherwise("TR")
    cheap = F.when(F.col(t) > 0, "T").when(F.col(r) > 0, "R")
    rows = rows.where(best > 0).select(key, best.alias("_u"), wish.alias("_wish"), cheap.alias("_cheap"), F.when(wish == "TR", 2).otherwise(1).alias("_cost"))
    held = running_by_range(rows, "_u", {"_before": "_cost"}, descending=True, tie=key).withColumn("_in", F.col("_before") + F.col("_cost") <= budget)
    spent = held.agg(F.coalesce(F.sum(F.when(F.col("_in"), F.col("_cost"))), F.lit(0)).alias("s"))
    # of the rows beyond, a single T or R never exceeds a unit that is left, so only those after the last that fits matter
    single = F.when(F.col("_wish") != "TR", F.col("_wish")).otherwise(F.col("_cheap"))
    odd = held.where(~F.col("_in") & single.isNotNull()).agg(F.min(F.struct((-F.col("_u")).alias("u"), F.col(key).alias("_k"))).alias("x"))
    one = odd.crossJoin(spent).where(F.col("s") < budget).select("x._k")
    last = held.join(F.broadcast(one), held[key] == F.col("_k"), "left")
    return last.where(F.col("_in") | F.col("_k").isNotNull()).select(key, F.when(F.col("_in"), F.col("_wish")).otherwise(single).alias("action"))


def first_sorted(values: Column, most: int) -> Column:
    """The first ``most`` distinct values, sorted."""
    return F.slice(F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull()))), 1, most)
