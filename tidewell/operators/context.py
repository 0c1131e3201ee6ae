"""Event-time context of dense keys: strictly-past windows of several horizons whose cost does not grow with a window's rows.

A row contributes at one time and asks at another (its end and its start, say); of its key it sees what contributed in
``[asked - horizon, asked)``. Each contribution enters a timeline once and leaves it once for each horizon, so counts, sums
and distinct counts are running totals: a distinct value leaves when its key sees it again or its horizon ends, whichever
is first. The timeline is cut to blocks of time, and the blocks' totals, a row for each key and block, are summed
across; so a key that holds a third of all rows, or all, is many tasks' work.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows at the end of a window whose starts make its interval statistics.
RECENT = 64


def past_context(rows: DataFrame, keys: list[str], row: str, contributes: str, asks: str, horizons: Mapping[str, int], sums: Mapping[str, Column], distincts: Mapping[str, Column], eligible: Column | None = None, block: int = 86_400_000) -> DataFrame:
    """``row`` and, for each horizon ``h``, ``{name}_{h}`` of every sum and distinct count; ``last``, the latest contribution before, and ``asked``, the time.

    Times are whole numbers. Rows with a null key have no context; null values count in no sum and are no distinct value.
    Rows that are not ``eligible`` ask but do not contribute.
    """
    given = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    base = rows.select(
        *keys, F.col(row).alias("_id"), F.col(asks).alias("_asks"), F.when(given, F.col(contributes)).alias("_from"),
        *[F.when(given, F.coalesce(c, F.lit(0))).cast("long").alias(f"_s_{n}") for n, c in sums.items()],
        *[F.when(given, c).alias(f"_v_{n}") for n, c in distincts.items()],
    ).dropna(subset=keys)
    for n in distincts:
        again = Window.partitionBy(*keys, f"_v_{n}").orderBy("_from", "_id")
        base = base.withColumn(f"_n_{n}", F.when(F.col("_from").isNotNull(), F.lead("_from").over(again)))
    spans, names = list(horizons.values()), list(distincts)

    def event(at: Column, kind: int, h: int = -1, d: int = -1, when: Column | None = None) -> Column:
        made = F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(h).alias("h"), F.lit(d).alias("d"))
        return made if when is None else F.when(when, made)

    came = F.col("_from").isNotNull()
    events = [event(F.col("_asks"), 0), event(F.col("_from"), 1, when=came)]
    events += [event(F.col("_from") + s, 2, h, when=came) for h, s in enumerate(spans)]
    leaves = lambda n, s: F.least(F.col(f"_n_{n}"), F.col("_from") + s)
    events += [event(leaves(n, s), 2, h, d, came & F.col(f"_v_{n}").isNotNull()) for d, n in enumerate(names) for h, s in enumerate(spans)]
    line = base.select(*keys, "_id", *[f"_s_{n}" for n in sums], *[F.col(f"_v_{n}").isNotNull().alias(f"_h_{n}") for n in names], "_from", F.explode(F.array_compact(F.array(*events))).alias("_e"))
    line = line.select("*", "_e.*").drop("_e")
    enters = F.col("kind") == 1
    exits = lambda h, d: (F.col("kind") == 2) & (F.col("h") == h) & (F.col("d") == d)
    totals = {}
    for h, label in enumerate(horizons):
        for n in sums:
            totals[f"{n}_{label}"] = F.sum(F.when(enters, F.col(f"_s_{n}")).when(exits(h, -1), -F.col(f"_s_{n}")))
        for d, n in enumerate(names):
            totals[f"{n}_{label}"] = F.sum(F.when(enters & F.col(f"_h_{n}"), 1).when(exits(h, d), -1))
    out = before(line.withColumnRenamed("_id", row), keys, "at", totals, {"last": F.max(F.when(enters, F.col("at")))}, block, "kind = 0")
    return out.select(row, *totals, "last", F.col("at").alias("asked"))


def before(line: DataFrame, keys: list[str], at: str, sums: Mapping[str, Column], most: Mapping[str, Column], block: int, asked: str) -> DataFrame:
    """The ``asked`` rows of a timeline with sums and maxima over the rows of their keys that come strictly before them.

    ``sums`` and ``most`` are aggregates. A window sees the rows of a key within a block of time; what came in earlier
    blocks is one row for each key and block, summed across.
    """
    line = line.withColumn("_block", F.floor(F.col(at) / block))
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = line.groupBy(*keys, "_block").agg(*[t.alias(n) for n, t in {**sums, **most}.items()])
    earlier = blocks.select(*keys, "_block", *[F.coalesce(F.sum(n).over(across), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.max(n).over(across).alias(f"_b_{n}") for n in most])
    near = Window.partitionBy(*keys, "_block").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    found = {n: (F.coalesce(t.over(near), F.lit(0)) + F.col(f"_b_{n}")).cast("long") for n, t in sums.items()}
    found |= {n: F.coalesce(t.over(near), F.col(f"_b_{n}")) for n, t in most.items()}
    return line.join(earlier, [*keys, "_block"]).withColumns(found).where(asked).drop("_block", *[f"_b_{n}" for n in found])


def crowded_context(claims: DataFrame, targets: DataFrame, keys: list[str], owner: str, holder: str, time: str, row: str, asks: str, horizon: int, out: str, block: int = 86_400_000) -> DataFrame:
    """``row`` and how many owners of the key are claimed by two holders or more in ``[asks - horizon, asks)``.

    A pair of owner and holder is there from a claim to the next one of the same pair, or to the end of its horizon. An
    owner's number of pairs is a running total, and where it passes between one and two the key's number of crowded owners
    changes; that number is a running total in turn. Nothing joins claims with targets.
    """
    again = Window.partitionBy(*keys, owner, holder).orderBy(time)
    c = claims.dropna(subset=[*keys, owner, holder, time]).select(*keys, owner, holder, F.col(time).alias("_t"), F.least(F.lead(time).over(again), F.col(time) + horizon).alias("_u"))
    steps = c.select(*keys, owner, F.explode(F.array(F.struct(F.col("_t").alias("at"), F.lit(1).alias("d")), F.struct(F.col("_u").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, owner, "e.*")
    net = steps.groupBy(*keys, owner, "at").agg(F.sum("d").alias("d"))
    upto = F.sum("d").over(Window.partitionBy(*keys, owner).orderBy("at"))
    turns = net.withColumn("n", upto).select(*keys, "at", ((F.col("n") >= 2).cast("int") - (F.col("n") - F.col("d") >= 2).cast("int")).alias("turn")).where("turn <> 0")
    line = turns.select(*keys, "at", "turn", F.lit(None).cast(dict(targets.dtypes)[row]).alias(row)).unionByName(targets.select(*keys, F.col(asks).alias("at"), F.lit(0).alias("turn"), row))
    found = before(line, keys, "at", {out: F.sum("turn")}, {}, block, f"{row} is not null")
    return found.select(row, out)


#: Rows that ``recent_context`` counts at once, but for a key's block that has more.
AT_ONCE = 200_000


def recent_context(seen: DataFrame, asked: DataFrame, keys: list[str], ids: list[str], at: str, horizons: Mapping[str, int], sums: list[str], distincts: list[str]) -> DataFrame:
    """``ids`` of every ``asked`` row, for each horizon ``{name}_{h}`` of sums and distinct counts over the ``seen`` rows of its key in
    ``[at - horizon, at)``, and ``last``, the latest ``at`` within the longest horizon (null if there is none).

    All columns are whole numbers; rows with a null key or time neither count nor ask, null values count in nothing. The
    result is that of ``past_context``, for many sums of many horizons at once: as SQL each is a window expression of its own, of
    which the plan outgrows the driver. Time is cut to blocks of the longest horizon; a task gets a key's block with the
    one before, and finds sums as differences of running totals and distinct values as those that came less those that
    left (as the key sees them again, or their horizon ends).
    """
    spans = list(horizons.values())
    block, far = max(spans), 4 * max(spans)
    names = [f"{n}_{h}" for h in horizons for n in [*sums, *distincts]]
    long = lambda *cols: [F.col(c).cast("long").alias(c) for c in cols]
    none = lambda cols: [F.lit(None).cast("long").alias(c) for c in cols]
    first = F.floor(F.col(at) / block)
    c = seen.select(*long(*keys, at), *none(ids), *long(*sums, *distincts), F.lit(False).alias("_asks"), F.explode(F.array(first, first + 1)).alias("_block"))
    a = asked.select(*long(*keys, at, *ids), *none([*sums, *distincts]), F.lit(True).alias("_asks"), first.alias("_block"))
    line = c.unionByName(a).dropna(subset=[*keys, at])
    where = {c: k for k, c in enumerate(line.columns)}
    ddl = ", ".join(f"{n} long" for n in [*ids, *names, "last"])
    schema = pa.schema([pa.field(n, pa.int64()) for n in [*ids, *names, "last"]])

    def counted(t: pa.Table) -> pa.RecordBatch:
        get = lambda n: t.column(where[n]).to_numpy()
        full = lambda n, rows: t.column(where[n]).fill_null(0).to_numpy()[rows]
        new = np.zeros(t.num_rows, bool)
        for k in [*keys, "_block"]:
            x = get(k)
            new[1:] |= x[1:] != x[:-1]
        asks = get("_asks").astype(bool)
        group = np.cumsum(new)
        # a place in time that no other group's reaches: from a horizon before the block's start on
        place = group * far + (get(at) - get("_block") * block + block)
        rows = np.flatnonzero(~asks)
        rows = rows[np.argsort(place[rows], kind="stable")]
        came, now = place[rows], place[asks]
        hi = np.searchsorted(came, now)
        lows = [np.searchsorted(came, now - s) for s in spans]
        out = {}
        for n in sums:
            total = np.concatenate([[0], np.cumsum(full(n, rows))])
            for h, lo in zip(horizons, lows):
                out[f"{n}_{h}"] = total[hi] - total[lo]
        for n in distincts:
            some = rows[t.column(where[n]).is_valid().to_numpy(zero_copy_only=False)[rows]]
            value, at_place = full(n, some), place[some]
            order = np.lexsort((at_place, value, group[some]))
            v, p, g = value[order], at_place[order], group[some][order]
            again = np.full(len(p), np.iinfo(np.int64).max)
            same = (v[1:] == v[:-1]) & (g[1:] == g[:-1])
            again[:-1][same] = p[1:][same]
            entered = np.searchsorted(at_place, now)
            for h, s in zip(horizons, spans):
                out[f"{n}_{h}"] = entered - np.searchsorted(np.sort(np.minimum(again, p + s)), now)
        widest = lows[spans.index(block)]
        times = np.concatenate([get(at)[rows], [0]])
        last = pa.array(times[hi - 1], mask=hi <= widest)
        return pa.RecordBatch.from_arrays([*[t.column(where[i]).combine_chunks().filter(pa.array(asks)) for i in ids], *[pa.array(out[n].astype(np.int64)) for n in names], last], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, wait = [], 0, AT_ONCE
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= wait:
                t = pa.Table.from_batches(held).combine_chunks()
                x = np.stack([t.column(where[k]).to_numpy() for k in [*keys, "_block"]])
                ends = np.flatnonzero((x[:, 1:] != x[:, :-1]).any(0))
                if len(ends):  # the last group may go on
                    yield counted(t.slice(0, int(ends[-1]) + 1).combine_chunks())
                    t = t.slice(int(ends[-1]) + 1)
                held, rows = t.to_batches(), t.num_rows
                wait = rows + AT_ONCE
        if rows:
            yield counted(pa.Table.from_batches(held).combine_chunks())

    return line.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block").mapInArrow(run, ddl)


class _Span:
    """What one horizon of one key holds just now: how often each value, and the starts in order."""

    def __init__(self):
        self.values: Counter = Counter()
        self.sizes: Counter = Counter()
        self.most = 0
        self.starts: list[int] = []
        self.gaps = [0, 0, 0]
        self.recent: deque[int] = deque()

    def _gap(self, a: int, b: int, sign: int) -> None:
        if b > a:
            for k, x in enumerate((1, b - a, (b - a) ** 2)):
                self.gaps[k] += sign * x

    def _between(self, at: int, start: int, sign: int) -> None:
        left, right = self.starts[at - 1] if at else None, self.starts[at] if at < len(self.starts) else None
        for a, b, s in ((left, start, sign), (start, right, sign), (left, right, -sign)):
            if a is not None and b is not None:
                self._gap(a, b, s)

    def put(self, value, start: int) -> None:
        self.sizes[self.values[value]] -= 1
        self.values[value] += 1
        self.sizes[self.values[value]] += 1
        self.most = max(self.most, self.values[value])
        self._between(bisect_left(self.starts, start), start, 1)
        insort(self.starts, start)
        self.recent.append(start)

    def take(self, value, start: int) -> None:
        self.sizes[self.values[value]] -= 1
        self.values[value] -= 1
        if self.values[value]:
            self.sizes[self.values[value]] += 1
        else:
            del self.values[value]
        while self.most and not self.sizes[self.most]:
            self.most -= 1
        del self.starts[at := bisect_left(self.starts, start)]
        self._between(at, start, -1)
        self.recent.popleft()

    def told(self) -> list[int]:
        last = sorted(list(self.recent)[-RECENT:]) if len(self.recent) > RECENT else sorted(self.recent)
        steps = [b - a for a, b in zip(last, last[1:])]
        return [self.most, *self.gaps, len(steps), sum(steps), sum(s * s for s in steps)]


TOLD = ("most", "gaps", "gap_sum", "gap_squares", "recent_gaps", "recent_sum", "recent_squares")


def sliding_profile(rows: DataFrame, keys: list[str], row: str, start: str, end: str, value: str, horizons: Mapping[str, int]) -> DataFrame:
    """``row`` and for each horizon, of the rows of the key that ended in ``[start - horizon, start)``: how many have the commonest
    ``value`` (``most``); number, sum and squares of the positive gaps between their starts in order; and the same of all
    gaps between the starts of the ``RECENT`` that ended last.

    These cannot be running totals. A task walks through its keys in order of time and holds one key's windows; each row enters
    and leaves once for each horizon.
    """
    spans = list(horizons.values())
    kinds = dict(rows.dtypes)
    enter = F.struct(F.col(end).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("h"))
    leave = [F.struct((F.col(end) + s).cast("long").alias("at"), F.lit(2).alias("kind"), F.lit(h).alias("h")) for h, s in enumerate(spans)]
    ask = F.struct(F.col(start).cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("h"))
    line = rows.select(F.xxhash64(*keys).alias("_k"), *keys, F.col(row).alias("_id"), F.col(start).cast("long").alias("_s"), F.col(value).cast("string").alias("_v"), F.explode(F.array(ask, enter, *leave)).alias("e"))
    line = line.select("_k", F.concat_ws("\x1f", *keys).alias("_key"), "_id", "_s", "_v", "e.*")
    names = [f"{n}_{label}" for label in horizons for n in TOLD]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, out = None, [], []
        for frame in frames:
            for key, i, s, v, kind, h in zip(*(frame[c] for c in ("_key", "_id", "_s", "_v", "kind", "h"))):
                if key != now:
                    now, held = key, [_Span() for _ in spans]
                if kind == 0:
                    out.append((i, *(x for span in held for x in span.told())))
                elif kind == 1:
                    for span in held:
                        span.put(v, s)
                else:
                    held[h].take(v, s)
            if out:
                yield pd.DataFrame(out, columns=[row, *names])
                out = []

    ordered = line.repartition("_k").sortWithinPartitions("_k", "_key", "at", "kind", "_s", "_id")
    return ordered.mapInPandas(walk, f"{row} {kinds[row]}, " + ", ".join(f"{n} long" for n in names))


def anomalies(claims: DataFrame, keys: list[str], owner: str, holder: str, time: str, order: str) -> DataFrame:
    """``keys, at, endpoint, kind``: the times at which a mapping of owners (addresses) to holders (hardware) turns odd.

    A claim by a second holder of an owner marks the owner at every claim from then on (``multiple_holders``), and the
    claim of a holder that is new to the owner is a ``mapping_change``. Likewise a holder of a second owner marks all owners it has so
    far (``multiple_owners``), each, and a claim of an owner that is new to it is a ``mapping_change`` of each of them.
    First sights are found by key, so that the number of pairs, not of claims, is what a holder's list holds.
    """
    by = lambda *c: Window.partitionBy(*keys, *c).orderBy(time, order)
    rows = claims.dropna(subset=[owner, holder]).withColumn("_new", F.row_number().over(by(owner, holder)) == 1)
    fresh = F.when(F.col("_new"), 1)
    upto = lambda c: by(c).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_holders": F.count(fresh).over(upto(owner)), "_owners": F.count(fresh).over(upto(holder))})
    event = lambda c, kind, when: rows.where(when).select(*keys, F.col(time).alias("at"), c.alias("endpoint"), F.lit(kind).alias("kind"))
    own = F.col(owner)
    out = event(own, "multiple_holders", F.col("_holders") > 1).union(event(own, "mapping_change", (F.col("_holders") > 1) & F.col("_new")))
    odd = rows.where(F.col("_owners") > 1).select(*keys, F.col(holder).alias("_h"), F.col(time).alias("at"), F.col(order).alias("_o"), "_new")
    firsts = rows.where("_new").select(*keys, F.col(holder).alias("_h"), F.col(time).alias("_t"), F.col(order).alias("_p"), own.alias("endpoint"))
    each = odd.join(firsts, [*keys, "_h"]).where((F.col("_t") < F.col("at")) | ((F.col("_t") == F.col("at")) & (F.col("_p") <= F.col("_o"))))
    marks = each.select(*keys, "at", "endpoint", F.lit("multiple_owners").alias("kind"))
    return out.union(marks).union(each.where("_new").select(*keys, "at", "endpoint", F.lit("mapping_change").alias("kind")))


def linked_context(targets: DataFrame, events: DataFrame, keys: list[str], row: str, time: str, ends: list[str], horizon: int, counts: Mapping[str, Column], distincts: Mapping[str, Column]) -> DataFrame:
    """``row`` and counts and distinct counts over the events of ``keys, at, endpoint`` that touch one of a target's endpoints in ``[time - horizon, time)``.

    Endpoints join by key and by bucket of time, of a horizon's length, so a target meets the events of two buckets.
    """
    bucket = F.floor(F.col("at") / horizon)
    e = events.withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
    asked = targets.select(*keys, F.col(row).alias("_id"), F.col(time).alias("_t"), F.explode(F.array_distinct(F.array(*ends))).alias("endpoint")).withColumn("_b", F.floor(F.col("_t") / horizon))
    met = asked.join(e, [*keys, "endpoint", "_b"]).where((F.col("at") < F.col("_t")) & (F.col("at") >= F.col("_t") - horizon))
    found = met.groupBy("_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()], *[F.count_distinct(c).alias(n) for n, c in distincts.items()])
    return targets.select(F.col(row).alias("_id")).join(found, "_id", "left").na.fill(0).withColumnRenamed("_id", row)
