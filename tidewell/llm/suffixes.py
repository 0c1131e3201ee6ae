"""Removal of long repeated passages, exact to the byte.

Texts are UTF-8 bytes (null: empty); matches never cross documents. A byte is covered by a match if it lies in a string
of ``MATCH`` bytes that also starts elsewhere. ``later`` keeps the first occurrence in the order of (doc_id, text hash,
place) and removes the others; ``all`` removes every occurrence. Null ids come first in that order. Rows equal in id
and text have one place in the order: for ``all`` they are repeats of each other, for ``later`` they are not.

How: each string of ``MATCH`` bytes has one anchor, the least hash among its ``GRAM``-byte grams, which depends on its
bytes alone. So equal strings have equal anchors at equal offsets, and

1. each run of strings of one anchor, about 75 of them, is a row: the anchor's hash and the hash of the run's bytes;
2. anchors that occur once cannot hold a repeat and go, by a join with the counts of anchors;
3. runs equal as a whole are settled by counting;
4. runs that share an anchor but differ, as at a passage's ends, are brought together by anchor with their bytes. There a
   suffix array with common prefixes is built of the strings that start in them, and the longest-previous-factor rule
   decides: the previous and the next smaller position in suffix order are the only candidates for the longest earlier
   match. ``all`` also asks for the longest match that starts later, by the same rule with places counted from the end.

An anchor with over ``HOT`` differing runs is not gathered in one task: its strings are counted by hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import arrow_schema, batch_of, id_text, map_batches, settled, written
from tidewell.llm.simhash import signed_hash

MATCH, GRAM = 200, 51
SPAN = MATCH - GRAM + 1
#: Differing runs of an anchor up to which one task gathers them, and bytes of the texts that a task treats at once.
HOT, BLOCK = 20_000, 1 << 20
#: Keys at most that a join broadcasts as frequent, and parts to which the rows of each are dealt.
HOT_KEYS, SALTS = 4096, 64
FACTOR = 0x9E3779B97F4A7C15
NO_ID = -(1 << 63)


def rolling(x: np.ndarray, length: int) -> np.ndarray:
    """A hash of each string of ``length`` bytes, by joining hashes of shorter ones; mixed at the end."""
    def join(a, la, b, lb):
        n = len(x) - la - lb + 1
        return a[:n] * np.uint64(pow(FACTOR, lb, 1 << 64)) + b[la : la + n]

    if len(x) < length:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, x.astype(np.uint64) + np.uint64(1), 1
    while True:
        if length & size:
            out, done = (power, size) if out is None else (join(out, done, power, size), done + size)
        if 2 * size > length:
            break
        power, size = join(power, size, power, size), 2 * size
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima within blocks of that width."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(parts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """``part, first start, starts, anchor hash, hash of bytes`` of each run of ``MATCH``-byte strings of one anchor."""
    joined = b"".join(parts)
    if len(joined) < MATCH:
        return []
    grams = rolling(np.frombuffer(joined, np.uint8), GRAM)
    low = np.uint64((1 << 28) - 1)
    anchor = (sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), SPAN) & low).astype(np.int64)
    ends = np.cumsum([len(p) for p in parts])
    part = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    inside = np.arange(len(anchor)) + MATCH <= ends[part]
    change = np.flatnonzero(inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
    if not len(change):
        return []
    last = np.concatenate([change[1:], [len(anchor)]])
    last = np.minimum(last, ends[part[change]] - MATCH + 1)
    first = ends - [len(p) for p in parts]
    hashes = grams[anchor[change]].view(np.int64).tolist()
    return [(p, a - int(first[p]), b - a, h, signed_hash(joined[a : b + MATCH - 1])) for p, a, b, h in zip(part[change].tolist(), change.tolist(), last.tolist(), hashes)]


def segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of ``text number, offset, bytes``, each list of about ``BLOCK`` bytes; a longer text is cut with overlap, so that no string is lost."""
    held, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - MATCH + 1), BLOCK):
            piece = t[at : at + BLOCK + MATCH - 1]
            held.append((k, at, piece))
            size += len(piece)
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def smaller_before(v: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest earlier place of a smaller value, or -1, and the least of ``common`` on the way to it.

    By pointer jumping: ``common[i]`` belongs to the step from ``i - 1`` to ``i``.
    """
    p, least = np.arange(-1, len(v) - 1), common.copy()
    todo = np.arange(len(v))
    while len(todo := todo[(p[todo] >= 0) & (v[p[todo]] > v[todo])]):
        at = p[todo]
        p[todo], least[todo] = p[at], np.minimum(least[todo], least[at])
    return p, np.where(p >= 0, least, 0)


def previous_factors(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array in suffix order: how long a prefix of each suffix also starts at an earlier place.

    Of the suffixes that start earlier, the longest match is the previous or the next one in suffix order; ``common[i]``
    is the length of the prefix that suffixes ``i - 1`` and ``i`` of the order share.
    """
    before = smaller_before(order, common)[1]
    after = smaller_before(order[::-1], np.concatenate([[0], common[:0:-1]]))[1][::-1]
    return np.maximum(before, after)


def suffix_order(x: bytes, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in order of their first ``depth`` bytes and then place, and the prefix that each shares with the one before.

    A suffix array of the given starts with its common prefixes, both cut off at ``depth``: starts whose string occurs
    once can match nothing and are left out. Classes of equal strings are found by hash and checked byte by byte (bytes
    decide where hashes collide); one of each class is sorted.
    """
    every = rolling(np.frombuffer(x, np.uint8), depth)[starts]
    _, of, count = np.unique(every, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[of] > 1)
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    strings = np.lib.stride_tricks.sliding_window_view(np.frombuffer(x, np.uint8), depth)

    def classes(starts, of):
        order = np.lexsort((starts, of))
        starts, of = starts[order], of[order]
        new = np.concatenate([[True], of[1:] != of[:-1]])
        return starts, starts[new], np.cumsum(new) - 1

    chosen = starts[some]
    starts, first, number = classes(chosen, of[some])
    parts = [slice(at, at + (1 << 16)) for at in range(0, len(starts), 1 << 16)]
    if not all(np.array_equal(strings[starts[p]], strings[first[number[p]]]) for p in parts):
        known: dict[bytes, int] = {}
        starts, first, number = classes(chosen, np.array([known.setdefault(x[k : k + depth], len(known)) for k in chosen.tolist()]))
    if 0 in x:  # byte zero ends an S string in numpy; compare as raw records
        by = np.array(sorted(range(len(first)), key=lambda k: x[first[k] : first[k] + depth]))
    else:
        by = np.argsort(np.ascontiguousarray(strings[first]).view(f"S{depth}").ravel(), kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[by] = np.arange(len(first))
    shared = np.zeros(len(first), np.int64)  # by rank, with the class before
    for at in range(1, len(by), 1 << 14):
        here = by[at : at + (1 << 14)]
        shared[at : at + len(here)] = (strings[first[here]] != strings[first[by[at - 1 : at - 1 + len(here)]]]).argmax(1)
    order = np.lexsort((starts, rank[number]))
    starts, rank = starts[order], rank[number][order]
    new = np.concatenate([[True], rank[1:] != rank[:-1]])
    return starts, np.where(new, shared[rank], depth)


def repeated(x: bytes, starts: np.ndarray, depth: int, later: bool) -> np.ndarray:
    """Those of the starts whose ``depth`` bytes occur at another start (``later``: at an earlier one), by their factors.

    A start repeats an earlier one if its longest previous factor has ``depth`` bytes, and is repeated by a later one if
    its longest factor that starts later has: the same rule with the places counted from the end.
    """
    order, common = suffix_order(x, starts, depth)
    hit = previous_factors(order, common) >= depth
    if not later:
        hit |= previous_factors(-order, common) >= depth
    return np.sort(order[hit])


ROW_DDL = "k long, mark long, at long, h long, c long"


def _pack(first: int, count: int) -> int:
    return first << 8 | count


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        marks = [signed_hash(t) for t in texts]
        for some in segments(texts):
            found = [(some[p][0], some[p][1] + a, n, h, c) for p, a, n, h, c in runs([s[2] for s in some])]
            if found:
                k, a, n, h, c = zip(*found)
                yield batch_of({"k": [ids[i] for i in k], "mark": [marks[i] for i in k], "at": list(map(_pack, a, n)), "h": list(h), "c": list(c)}, ROW_DDL)


CTX_DDL = "h long, k long, mark long, at long, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: dict[str, list] = {f.name: [] for f in arrow_schema(CTX_DDL)}
        for k, mark, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                a, n = w["at"] >> 8, w["at"] & 255
                for name, v in (("h", w["h"]), ("k", k), ("mark", mark), ("at", w["at"]), ("bytes", raw[a : a + n + MATCH - 1])):
                    cols[name].append(v)
        yield batch_of(cols, CTX_DDL)


FOUND_DDL = "k long, mark long, at long"


def _settle(later: bool):
    """Over rows in order of ``h``: the runs of starts that repeat, each as first start and count."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[1:4])  # so that places in the joined bytes follow the order of the documents
        joined = b"".join(r[4] for r in rows)
        begin = np.cumsum([0] + [len(r[4]) for r in rows])
        counts = np.array([r[3] & 255 for r in rows])
        of = np.repeat(np.arange(len(rows)), counts)
        within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        hit = repeated(joined, begin[of] + within, MATCH, later)
        row = np.searchsorted(begin, hit, side="right") - 1
        new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1])])) if len(hit) else np.zeros(0, int)
        size = np.diff(np.concatenate([new, [len(hit)]]))
        out: dict[str, list] = {"k": [], "mark": [], "at": []}
        for r, p, n in zip(row[new].tolist(), hit[new].tolist(), size.tolist()):
            out["k"].append(rows[r][1])
            out["mark"].append(rows[r][2])
            out["at"].append(_pack((rows[r][3] >> 8) + p - int(begin[r]), n))
        return batch_of(out, FOUND_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK and r[0] != last:
                    yield settle(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
                last = r[0]
        if held:
            yield settle(held)

    return run


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ddl = "k long, mark long, start long, s long"
    for batch in batches:
        for _, k, mark, at, raw in zip(*(c.to_pylist() for c in batch.columns)):
            n = at & 255
            yield batch_of({"k": [k] * n, "mark": [mark] * n, "start": [(at >> 8) + i for i in range(n)], "s": [signed_hash(raw[i : i + MATCH]) for i in range(n)]}, ddl)


def salted_join(rows: DataFrame, counted: DataFrame, keys: list[str], limit: int, by: list[str]) -> DataFrame:
    """``rows`` joined with ``counted``, of which each key has its count ``n`` of rows, so that no task gets a frequent key whole.

    Keys of over ``limit`` rows, fewer than there are rows over ``limit``, are broadcast; their rows are dealt to ``SALTS`` parts.
    """
    hot = F.broadcast(counted.where(F.col("n") > limit).select(*keys, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("_salt", part).drop("_hot")
    parts = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(counted.withColumn("_salt", F.explode(parts)), [*keys, "_salt"]).drop("_salt")


def found_runs(docs: DataFrame, later: bool) -> DataFrame:
    """``k, mark, at``: runs of starts, in the text of that id and hash, whose strings repeat. ``docs`` has ``k, text``."""
    return settled(docs.sparkSession, "repeats", lambda: _found_runs(docs, later))


def _found_runs(docs: DataFrame, later: bool) -> DataFrame:
    every = map_batches(docs.select("k", "text"), _anchors, ROW_DDL)
    twice, _ = written(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchor-counts")
    # at most HOT_KEYS keys have more rows than this
    limit = max(HOT, (twice.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    place = ["k", "mark", "at"]
    rows, _ = written(salted_join(every, twice, ["h"], limit, place).select("h", "c", *place), "anchors")
    wholes = rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("o"))
    settled = salted_join(rows, wholes.where("n > 1"), ["h", "c"], limit, place)
    if later:
        settled = settled.where((F.col("k") != F.col("o.k")) | (F.col("mark") != F.col("o.mark")) | (F.col("at") != F.col("o.at")))
    settled = settled.select(*place)
    differing = wholes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    open_runs = salted_join(wholes.select("h", "c", "o"), differing, ["h"], limit, ["c"])
    open_runs = open_runs.select("h", F.col("n").alias("runs"), "o.k", "o.mark", "o.at")
    wanted = open_runs.groupBy("k", "mark").agg(F.collect_list(F.struct("h", "at", "runs")).alias("wanted"))
    texts = docs.select("k", F.xxhash64("text").alias("mark"), "text").join(wanted, ["k", "mark"]).dropDuplicates(["k", "mark"])

    def contexts(which):
        some = texts.select("k", "mark", "text", F.filter("wanted", which).alias("wanted")).where(F.size("wanted") > 0)
        thin = F.transform("wanted", lambda w: F.struct(w["h"].alias("h"), w["at"].alias("at"))).alias("wanted")
        return map_batches(some.select("k", "mark", "text", thin), _contexts, CTX_DDL)

    small = map_batches(contexts(lambda w: w["runs"] <= HOT).repartition("h").sortWithinPartitions("h"), _settle(later), FOUND_DDL)
    strings = map_batches(contexts(lambda w: w["runs"] > HOT), _strings, "k long, mark long, start long, s long")
    first = F.min(F.struct("k", "mark", "start")).alias("o")
    counted = strings.groupBy("s").agg(F.count("*").alias("n"), first).where("n > 1")
    large = salted_join(strings, counted, ["s"], limit, ["k", "mark", "start"])
    if later:
        large = large.where((F.col("k") != F.col("o.k")) | (F.col("mark") != F.col("o.mark")) | (F.col("start") != F.col("o.start")))
    return settled.union(small).union(large.select("k", "mark", (F.shiftleft("start", 8) + 1).alias("at")))


def spans(at: list[int] | None) -> list[tuple[int, int]]:
    """The maximal byte spans that some runs of starts cover."""
    out: list[list[int]] = []
    for a, b in sorted((x >> 8, (x >> 8) + (x & 255) - 1 + MATCH) for x in at or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for s in removed for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))


def _joined(docs: DataFrame, later: bool, extra: list[str]) -> DataFrame:
    """``docs`` with the runs found in each row's text, at most one row for each row."""
    base = docs.withColumns({"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    found = found_runs(base, later).groupBy("k", "mark").agg(F.collect_list("at").alias("_at"))
    return base.withColumn("mark", F.xxhash64("text")).join(found, ["k", "mark"], "left").select(*extra, "_at")


def digests(docs: DataFrame, later: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {f.name: [] for f in arrow_schema(ddl)}
            for i, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                raw, gone = text.encode("utf-8", "surrogatepass"), spans(at)
                for name, v in (("doc_id", i), ("n_bytes", len(raw)), ("n_removed", sum(b - a for a, b in gone)), ("n_spans", len(gone)), ("kept_sha256", hashlib.sha256(cut(raw, gone)).hexdigest())):
                    cols[name].append(v)
            yield batch_of(cols, ddl)

    return map_batches(_joined(id_text(docs), later, ["doc_id", "text"]), run, ddl)


def remove_repeats(docs: DataFrame, later: bool = True) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; bytes of a character cut in two go as well."""
    order = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                texts.append(cut(text.encode("utf-8", "surrogatepass"), spans(at)).decode("utf-8", "ignore") if at else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    others = [c for c in order if c != "text"]
    held = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(c) for c in others]).alias("_row"))
    found = _joined(held, later, ["_row", "text"])
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in held.schema["_row"].dataType.fields)
    out = map_batches(found, run, f"row struct<{fields}>, text string")
    return out.select("row.*", "text").select(*order)
