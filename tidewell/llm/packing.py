"""Packing of token ids into windows of fixed capacity.

Both packers read ``doc_id`` and ``text`` (null: empty), tokenize whole texts and put an end id after each, so every
row has at least one id. They run map-only: a task packs its own split in groups of a bounded number of tokens, so
no shuffle is needed, no group grows with the corpus, and a lost task repeats with the same result. Rows are packed
as they come: repeated ids and rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm import tokens
from tidewell.llm.common import arrow_schema, batch_of, id_text, map_batches, partition_number

WINDOW = 2048
#: The id that ends each document.
END = 1
#: Documents' rests are cut to pieces of at most so many ids before differencing: with several pieces in a window the sums come out near equal.
PIECE = 512
#: Tokens that one group holds: bounds a worker's memory and the windows that are differenced together.
GROUP = 2048 * 256


def difference(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each piece by Karmarkar-Karp multiway differencing.

    A partial partition is a list of window sums, largest first, that leaves out the empty windows; each sum carries its
    pieces as nested pairs. The two partitions of largest spread merge with opposing imbalances: the fullest windows of
    one meet the emptiest of the other, so while both leave windows empty their sums go side by side. What all windows
    have in common is taken off. Ties go to the older partition.
    """
    place = np.zeros(len(sizes), np.int64)
    if windows == 1 or not sizes:
        return place
    of_sum = operator.itemgetter(0)
    queue: list = [(-s, k, [(s, k)]) for k, s in enumerate(sizes)]
    heapq.heapify(queue)
    made = len(sizes)
    while len(queue) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(queue), heapq.heappop(queue)
        b = b[::-1]
        if (over := len(a) + len(b) - windows) > 0:  # so many windows are filled by both
            at = len(a) - over
            a = a[:at] + [(s + t, (p, q)) for (s, p), (t, q) in zip(a[at:], b)] + b[over:]
        else:
            a = a + b
        a.sort(key=of_sum, reverse=True)
        if len(a) == windows and (least := a[-1][0]):
            a = [(s - least, p) for s, p in a]
        heapq.heappush(queue, (-(a[0][0] - (a[-1][0] if len(a) == windows else 0)), made, a))
        made += 1
    for w, (_, pieces) in enumerate(queue[0][2]):
        todo = [pieces]
        while todo:
            if isinstance(p := todo.pop(), tuple):
                todo += p
            else:
                place[p] = w
    return place


def balanced(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each piece, sums at most ``capacity``: as few windows as the total asks for, one more while any is too full."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        place = difference(sizes, windows)
        if not sizes or np.bincount(place, weights=sizes).max() <= capacity:
            return place
        windows += 1


class Capacities:
    """A segment tree over the free capacities 0..top: how many open windows have each."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, free: int, window: int) -> None:
        self.windows[free].append(window)
        at = free + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The window of the least free capacity that is at least ``size``, and that capacity; it leaves the tree."""
        at, count = size + self.leaves, self.count
        while not count[at]:
            while at & 1:  # a right child: what is larger lies beyond its parent
                at >>= 1
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:  # beyond the last leaf of its level
                return None
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        free = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return self.windows[free].pop(), free


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The window of each piece, largest pieces first, each into the fullest window that takes it."""
    tree, place, opened = Capacities(capacity), [0] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        if found := tree.take(sizes[k]):
            place[k], free = found
        else:
            place[k], free, opened = opened, capacity, opened + 1
        tree.add(free - sizes[k], place[k])
    return place


def tokenized(batches: Iterator[pa.RecordBatch], path: str, end: int, memo: int = tokens.MEMO) -> Iterator[tuple[int, np.ndarray]]:
    of = tokens.of_file(path, memo)
    tail = np.array([end], "<u4")
    for batch in batches:
        for i, ids in zip(batch.column(0).to_pylist(), of.ids_batch(batch.column(1).to_pylist())):
            yield i, np.concatenate([ids, tail])


PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_balanced(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, piece: int = PIECE, group: int = GROUP, with_ids: bool = False, memo: int = tokens.MEMO) -> DataFrame:
    """A row for each piece of a document: where it starts there, its length and CRC-32, its window and its offset in it.

    Whole windows are cut from a document while it has them; its rest, in pieces of ``piece`` ids at most, is dealt
    out by Karmarkar-Karp differencing within a group. ``with_ids`` adds ``ids`` (little-endian unsigned 32-bit). ``memo``
    bounds the encoded pieces that a worker remembers.
    """
    ddl = PIECES_DDL + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = partition_number() << 32, 0
        names = [f.name for f in arrow_schema(ddl)]
        out: list[list] = [[] for _ in names]

        def put(i, ids, start, length, number, offset):
            raw = ids[start : start + length].tobytes()
            for c, v in zip(out, (i, start, length, zlib.crc32(raw), len(ids), first + number, offset, raw)):
                c.append(v)

        def deal(rests):
            place = balanced([r[3] for r in rests], window).tolist()
            fill = [0] * (max(place) + 1)
            for (i, ids, start, length), w in zip(rests, place):
                put(i, ids, start, length, made + w, fill[w])
                fill[w] += length
            return len(fill)

        rests: list = []
        held = 0
        for i, ids in tokenized(batches, path, end, memo):
            whole = len(ids) // window * window
            for start in range(0, whole, window):
                put(i, ids, start, window, made, 0)
                made += 1
            left = len(ids) - whole
            count = -(-left // piece)
            for k in range(count):
                a, b = left * k // count, left * (k + 1) // count
                rests.append((i, ids, whole + a, b - a))
            held += left
            if held >= group:
                made += deal(rests)
                rests, held = [], 0
            if len(out[0]) >= 512:
                yield batch_of(dict(zip(names, out)), ddl)
                out = [[] for _ in names]
        if rests:
            deal(rests)
        if out[0]:
            yield batch_of(dict(zip(names, out)), ddl)

    return map_batches(id_text(docs), run, ddl)


WINDOWS_DDL = "sequence_id long, n_tokens long, doc_ids array<long>, starts array<long>, cu_lengths array<int>, position_resets array<int>, ids binary"


def pack_best_fit(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, group: int = 2048 * 1024, pad: int = 0) -> DataFrame:
    """A row for each window: the row of the packed id matrix and where its documents' segments lie.

    ``ids`` has ``window`` little-endian unsigned 16-bit ids, padded with ``pad``; ``doc_ids`` and ``starts`` name each
    segment's document and the id of it that the segment begins with; ``cu_lengths`` are the cumulative segment lengths
    from 0 to ``n_tokens``; positions restart from 0 at ``position_resets``, padding included. A document over
    ``window`` ids is cut into whole windows and a rest, so no id is lost.
    """
    ddl = WINDOWS_DDL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = partition_number() << 32, 0

        def rows(pieces):
            nonlocal made
            place = best_fit_decreasing([p[3] for p in pieces], window)
            members: list[list] = [[] for _ in range(max(place) + 1)]
            for p, w in zip(pieces, place):
                members[w].append(p)
            for at in range(0, len(members), 256):
                some = members[at : at + 256]
                matrix = np.full((len(some), window), pad, "<u2")
                cols: dict[str, list] = {f.name: [] for f in arrow_schema(ddl)}
                for row, inside in zip(matrix, some):
                    cu = [0]
                    for _, ids, start, length in inside:
                        row[cu[-1] : cu[-1] + length] = ids[start : start + length]
                        cu.append(cu[-1] + length)
                    for name, v in (("sequence_id", first + made), ("n_tokens", cu[-1]), ("doc_ids", [p[0] for p in inside]), ("starts", [p[2] for p in inside]), ("cu_lengths", cu), ("position_resets", cu if cu[-1] < window else cu[:-1]), ("ids", row.tobytes())):
                        cols[name].append(v)
                    made += 1
                yield batch_of(cols, ddl)

        pieces: list = []
        held = 0
        for i, ids in tokenized(batches, path, end):
            if len(ids) and int(ids.max()) > 0xFFFF:
                raise ValueError("ids beyond 16 bits")
            short = ids.astype("<u2")
            pieces += [(i, short, s, min(window, len(ids) - s)) for s in range(0, len(ids), window)]
            held += len(ids)
            if held >= group:
                yield from rows(pieces)
                pieces, held = [], 0
        if pieces:
            yield from rows(pieces)

    return map_batches(id_text(docs), run, ddl)


def positions(cu_lengths: list[int], window: int = WINDOW) -> np.ndarray:
    """The position of each id of a window within its segment, padding being a segment of its own."""
    at = np.arange(window)
    starts = np.array(cu_lengths)
    return at - starts[[bisect.bisect_right(cu_lengths, int(i)) - 1 for i in at]]
