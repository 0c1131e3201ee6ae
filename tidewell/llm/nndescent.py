"""Approximate nearest neighbours by inner product: a neighbour graph by NN-descent, searched greedily.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do vectors of another length than
the most frequent one (ties: the shorter). Equal vectors are one node, with the ``TOP + 1`` smallest of its ids: no
answer needs more of them. Fewer candidates than asked give fewer rows; an empty table gives none. Rows that repeat an
id and its vector are one row. Scores are inner products in double precision of the original components; ties go to
smaller ids. Other columns are not read.

Nodes lie in blocks of bounded size, the leaves of a tree of random planes (dealt further by hash where a bounded sample
can fit no deeper tree). A node's number is its block's number and its place there, so a number alone says where to
send a question. All that travels between blocks are packed messages of numbers, scores and, once for each block that
asks, a vector; a task holds one block and what was sent to it.

The graph starts from all pairs in cells of ``CELL`` nodes of two such trees. Then rounds of NN-descent follow until
fewer than ``SETTLED`` of the entries change: each node draws up to ``SAMPLED`` fresh and as many old neighbours, joins
them with as many of those that have drawn it, and every pair of these with a fresh member is compared. A round is four
exchanges: the draws to those drawn, questions for vectors, the vectors, and the pairs found.

A search starts at the query's own node's neighbours, expands all unexpanded nodes of a pool of ``POOL``, scores what is
new, and ends when a pool has no unexpanded node, or after ``HOPS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import arrow_schema, batch_of, delete, map_batches, settled, written

TOP = 20
#: Values of a block's vectors at most, nodes of a starting cell, and sampled values that fit the planes.
VALUES, CELL, SAMPLE = 1 << 17, 256, 20_000 * 64
#: Nodes of the sample that a leaf keeps at least, and bits of a node's place in its block.
LEAST, PLACE = 16, 12
#: Neighbours of a node, those drawn of each kind, pairs that a block sends on for a node.
WIDTH, SAMPLED, SENT = 48, 20, 24
ROUNDS, SETTLED = 12, 0.001
POOL, HOPS = 128, 10
#: Rows of an Arrow batch: a row is a packed message of up to about a megabyte.
ROWS = 32
#: Parts to which the queries of one very common vector are dealt.
SALTS = 32

MESSAGE = "block long, kind int, frm long, a binary, b binary, c binary"


def nodes_of(vectors: DataFrame, every: int) -> DataFrame:
    """``node, h, g, vec, ids, asks``: each distinct vector that takes part, two hashes of it, its first ids in order."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.where("vec_id is not null and vec is not null").where(finite & F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("vec") == (lengths[0]["d"] if lengths else 0))
    rows = rows.select("vec_id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))  # -0.0 is 0.0
    rows = rows.select("vec_id", "vec", F.xxhash64("vec").alias("h"), F.xxhash64("vec", F.lit(1)).alias("g")).distinct()
    near = Window.partitionBy("h", "g").orderBy("vec_id")
    some = rows.withColumn("rn", F.row_number().over(near)).where(F.col("rn") <= TOP + 1)
    held = some.groupBy("h", "g").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec"))
    asks = F.exists("ids", lambda i: i % every == 0) | (F.size("ids") > TOP)
    return held.select(F.col("ids")[0].alias("node"), "h", "g", "vec", "ids", asks.alias("asks"))


def plant(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree of random planes through medians: node ``k`` has children ``2k + 1`` and ``2k + 2``."""
    rng = np.random.default_rng(seed)
    planes, cuts = rng.normal(size=((1 << depth) - 1, sample.shape[1])), np.zeros((1 << depth) - 1)
    of = np.zeros(len(sample), int)
    for k in range(len(planes)):
        inside = of == k
        side = sample[inside] @ planes[k]
        cuts[k] = np.median(side) if len(side) else 0
        of[inside] = 2 * k + 1 + (side > cuts[k])
    return planes, cuts


def leaf_of(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    at = np.zeros(len(x), int)
    for _ in range(depth):
        at = 2 * at + 1 + (np.einsum("ij,ij->i", x, tree[0][at]) > tree[1][at])
    return at - ((1 << depth) - 1)


def cells(x: np.ndarray, size: int, seed: int) -> list[np.ndarray]:
    """The rows of ``x`` in cells of at most ``size``, split at medians of random directions."""
    rng, todo, out = np.random.default_rng(seed & 0x7FFFFFFF), [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        at = at[np.argsort(x[at] @ rng.normal(size=x.shape[1]), kind="stable")]
        todo += [at[: len(at) // 2], at[len(at) // 2 :]]
    return out


# --- packed messages ---------------------------------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batched(messages: Iterator[tuple], ddl: str = MESSAGE, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    names, out, size = [f.name for f in arrow_schema(ddl)], [], 0
    for m in messages:
        out.append(m)
        size += sum(len(x) for x in m if isinstance(x, bytes)) + 64
        if size >= most:
            yield batch_of(dict(zip(names, map(list, zip(*out)))), ddl)
            out, size = [], 0
    if out:
        yield batch_of(dict(zip(names, map(list, zip(*out)))), ddl)


Work = Callable[[int, Iterator[tuple]], Iterator[tuple]]


def _step(work: Work, spread: int, *parts: DataFrame, ddl: str = MESSAGE) -> DataFrame:
    """``work(block, rows)`` on each block's messages, which come in order of kind; what it yields are messages again."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    dealt = every.repartitionById(spread, F.pmod("block", F.lit(spread)).cast("int")).sortWithinPartitions("block", "kind", "frm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((m for block, rows in groupby(_rows(batches), itemgetter(0)) for m in work(block, rows)), ddl)

    return map_batches(dealt, run, ddl, ROWS)


def _kind(messages: DataFrame, kind: int, named: int) -> DataFrame:
    return messages.where(F.col("kind") == kind).withColumn("kind", F.lit(named))


def _split(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """For each block among ``to``, in order, the block and its parts of the columns."""
    if len(to):
        order = np.argsort(to, kind="stable")
        to, columns = to[order], [c[order] for c in columns]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]).tolist()
        for a, b in zip(cut, cut[1:]):
            yield (int(to[a]), *(c[a:b] for c in columns))


def _place_of(numbers: np.ndarray) -> np.ndarray:
    return (numbers & ((1 << PLACE) - 1)).astype("<u2")


def _numbers(block: int, count: int) -> np.ndarray:
    return (block << PLACE) + np.arange(count)


def best(target: np.ndarray, member: np.ndarray, score: np.ndarray, width: int) -> np.ndarray:
    """Which entries stay: of each target the ``width`` best distinct members, in order; of equal entries the first."""
    if not len(target):
        return np.zeros(0, np.int64)
    of = np.unique(member, return_inverse=True)[1]
    key = target.astype(np.int64) * (int(of.max()) + 1) + of
    order = np.argsort(key, kind="stable")
    order = order[np.concatenate([[True], np.diff(key[order]) != 0])]
    bits = score[order].astype(np.float32).view(np.int32).astype(np.int64)
    rising = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits)  # integers in the order of the floats
    order = order[np.argsort((target[order].astype(np.int64) << 33) - rising, kind="stable")]
    t = target[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1])
    rank = np.arange(len(t)) - np.repeat(first, np.diff(np.concatenate([first, [len(t)]])))
    return order[rank < width]


def _candidates(target: np.ndarray, member: np.ndarray, score: np.ndarray, frm: int) -> Iterator[tuple]:
    for block, t, m, s in _split(target >> PLACE, target, member, score):
        yield block, 5, frm, _place_of(t).tobytes(), m.astype("<i8").tobytes(), s.astype("<f4").tobytes()


# --- blocks and the starting graph ---------------------------------------------------------------------------------------

#: kind 0: vectors; kind 1: how many ids each node has, the ids, which nodes are asked for.
HELD = MESSAGE


def _unpacked(vectors: bytes, count: int) -> np.ndarray:
    return np.frombuffer(vectors, "<f8").reshape(count, -1)


def lay_out(nodes: DataFrame, values: int) -> tuple[DataFrame, tuple, int, int]:
    """The blocks as messages, the second tree with its depth and salts, the number of nodes and of blocks dealt to."""
    spark, n = nodes.sparkSession, nodes.count()
    first = nodes.select(F.size("vec")).first()
    dim = first[0] if first else 1
    cap = max(16, min(1 << PLACE, values // dim))
    bar = int(min(1.0, SAMPLE / dim / max(1, n)) * (1 << 30))
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= bar).select("node", "vec").collect()
    sample = np.array([r["vec"] for r in sorted(sample, key=itemgetter("node"))]).reshape(len(sample), dim)
    deep = int(np.ceil(np.log2(max(1.0, n / (0.8 * cap)))))
    depth = max(0, min(deep, int(np.log2(max(1, len(sample) // LEAST)))))
    salts = max(1, -(-n // int((0.8 * cap) * (1 << depth)))) if depth < deep else 1
    bases = salts << depth
    trees = spark.sparkContext.broadcast([plant(sample, depth, k) for k in range(2)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, vec, ids, asks = (batch.column(k) for k in range(4))
            x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
            own = node.to_numpy()
            base = leaf_of(x, trees.value[0], depth) * salts + (own * 0x9E3779B1 >> 16) % salts
            packed = [np.array(i, "<i8").tobytes() for i in ids.to_pylist()]
            raw = [r.tobytes() for r in x.astype("<f8")]
            yield batch_of(dict(zip(("block", "kind", "frm", "a", "b", "c"), (base.tolist(), [int(z) for z in asks.to_pylist()], own.tolist(), raw, packed, [None] * len(own)))), MESSAGE)

    def block_up(base: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        held, number = [], base

        def close():
            yield number, 0, len(held), b"".join(r[3] for r in held), None, None
            asks, counts = np.array([r[1] for r in held], np.uint8), np.array([len(r[4]) // 8 for r in held], np.uint8)
            yield number, 1, len(held), counts.tobytes(), b"".join(r[4] for r in held), asks.tobytes()

        for r in rows:
            held.append(r)
            if len(held) == cap:
                yield from close()
                held, number = [], number + bases
        if held:
            yield from close()

    placed = map_batches(nodes.select("node", "vec", "ids", "asks"), place, MESSAGE)
    spread = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), bases))
    held, _ = written(_step(block_up, spread, placed), "nn-blocks")
    return held, (trees, depth, salts), n, spread


def start(held: DataFrame, forest: tuple, n: int, spread: int, cell: int) -> DataFrame:
    """The state before the first round: of each node the best of its cells in two trees, all fresh."""
    trees, depth, salts = forest
    vectors = held.where("kind = 0")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages():
            for block, _, count, raw, _, _ in _rows(batches):
                x, own = _unpacked(raw, count), _numbers(block, count)
                leaf = leaf_of(x, trees.value[1], depth) * salts + (own * 0x85EBCA6B >> 16) % salts
                for to, who, some in _split(leaf, own, x):
                    yield to, 0, block, who.astype("<i8").tobytes(), some.astype("<f4").tobytes(), None

        yield from _batched(messages())

    def pairs(seed: int, x: np.ndarray, who: np.ndarray) -> Iterator[tuple]:
        found = []
        for at in cells(x, cell, seed):
            if len(at) > 1:
                s = x[at] @ x[at].T
                np.fill_diagonal(s, -np.inf)
                k = min(WIDTH, len(at) - 1)
                near = np.argpartition(-s, k - 1, axis=1)[:, :k]
                found.append((np.repeat(who[at], k), who[at[near]].ravel(), np.take_along_axis(s, near, 1).ravel()))
        if found:
            yield from _candidates(*map(np.concatenate, zip(*found)), seed)

    def in_leaf(leaf: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        who, x = [], []
        for r in rows:
            who.append(np.frombuffer(r[3], "<i8"))
            x.append(np.frombuffer(r[4], "<f4").reshape(len(who[-1]), -1))
            if sum(map(len, who)) >= 1 << PLACE:  # a leaf beyond what its sample foretold goes in parts
                yield from pairs(leaf, np.concatenate(x), np.concatenate(who))
                who, x = [], []
        if who:
            yield from pairs(leaf, np.concatenate(x), np.concatenate(who))

    def in_block(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        for r in rows:
            yield from pairs(~block, _unpacked(r[3], r[2]).astype(np.float32), _numbers(block, r[2]))

    def gather(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        count = next(rows)[2]
        empty = np.full((count, WIDTH), -1), np.full((count, WIDTH), -np.inf, np.float32), np.zeros((count, WIDTH), bool)
        yield from _state(block, *_merged(*empty, rows))

    second = _step(in_leaf, spread, map_batches(vectors, send, MESSAGE, ROWS))
    sizes = vectors.select("block", F.lit(0).alias("kind"), "frm", *[F.lit(None).cast("binary").alias(x) for x in "abc"])
    return _step(gather, spread, sizes, _step(in_block, spread, vectors), second)


# --- NN-descent ----------------------------------------------------------------------------------------------------------


def _state(block: int, near: np.ndarray, score: np.ndarray, fresh: np.ndarray, changed: int) -> Iterator[tuple]:
    """kind 0: neighbours, scores, which are fresh, how many changed; kind 1: the score that a new neighbour must beat."""
    yield block, 0, changed, near.astype("<i8").tobytes(), score.astype("<f4").tobytes(), fresh.astype(np.uint8).tobytes()
    yield block, 1, 0, score[:, -1].astype("<f4").tobytes(), None, None


def _opened(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    near = np.frombuffer(row[3], "<i8").reshape(-1, WIDTH)
    return near, np.frombuffer(row[4], "<f4").reshape(-1, WIDTH), np.frombuffer(row[5], bool).reshape(-1, WIDTH)


def _merged(near: np.ndarray, score: np.ndarray, fresh: np.ndarray, rows: Iterator[tuple]) -> tuple:
    """The state after some candidates came, and how many of them stay; merged whenever many are held."""
    n = len(near)
    came = np.zeros(near.shape, bool)

    def fold(state, held):
        near, score, fresh, came = state
        at, k = np.nonzero(near >= 0)
        t = np.concatenate([at, *(np.frombuffer(r[3], "<u2") for r in held)]).astype(np.int64)
        m = np.concatenate([near[at, k], *(np.frombuffer(r[4], "<i8") for r in held)])
        s = np.concatenate([score[at, k], *(np.frombuffer(r[5], "<f4") for r in held)])
        more = np.ones(len(t) - len(at), bool)
        f, c = np.concatenate([fresh[at, k], more]), np.concatenate([came[at, k], more])
        keep = best(t, m, s, WIDTH)
        t, m, s, f, c = t[keep], m[keep], s[keep], f[keep], c[keep]
        rank = np.arange(len(t)) - np.searchsorted(t, t)
        out = np.full((n, WIDTH), -1), np.full((n, WIDTH), -np.inf, np.float32), np.zeros((n, WIDTH), bool), np.zeros((n, WIDTH), bool)
        for x, v in zip(out, (m, s, f, c)):
            x[t, rank] = v
        return out

    state, held, size = (near, score, fresh, came), [], 0
    for r in rows:
        held.append(r)
        size += len(r[5]) // 4
        if size >= 1 << 19:
            state, held, size = fold(state, held), [], 0
    near, score, fresh, came = fold(state, held) if held else state
    return near, score, fresh, int(came.sum())


def drawn(near: np.ndarray, fresh: np.ndarray, seed: tuple[int, int]) -> np.ndarray:
    """Which neighbours a round joins: of each node up to ``SAMPLED`` fresh ones and as many old ones, at random."""
    chance = np.random.default_rng(seed).random(near.shape)
    out = np.zeros(near.shape, bool)
    for kind in ((near >= 0) & fresh, (near >= 0) & ~fresh):
        x = np.where(kind, chance, 2.0)
        out |= kind & (x <= np.partition(x, SAMPLED - 1, axis=1)[:, SAMPLED - 1 : SAMPLED])
    return out


def _some(owner: np.ndarray, member: np.ndarray, fresh: np.ndarray, seed: int) -> np.ndarray:
    """Up to ``SAMPLED`` entries of each owner and kind, by a hash of the pair."""
    mixed = (member.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + owner.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.lexsort((mixed, owner * 2 + fresh))
    key = (owner * 2 + fresh)[order]
    first = np.searchsorted(key, key)
    return order[np.arange(len(key)) - first < SAMPLED]


def one_round(held: DataFrame, state: DataFrame, spread: int, number: int) -> DataFrame:
    """The state after one round of NN-descent."""

    def draw(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        near, _, fresh = _opened(next(rows))
        at, k = np.nonzero(drawn(near, fresh, (block, number)))
        m, f = near[at, k], fresh[at, k].astype(np.uint8)
        yield block, 2, block, at.astype("<u2").tobytes(), m.tobytes(), f.tobytes()
        owner = _numbers(block, len(near))[at]
        keep = _some(m, owner, f, number)  # what no receiver would keep is not sent
        for to, who, own, flag in _split(m[keep] >> PLACE, m[keep], owner[keep], f[keep]):
            yield to, 3, block, _place_of(who).tobytes(), own.astype("<i8").tobytes(), flag.tobytes()

    def ask(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        parts, back = [], [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)]
        held: list = []

        def fold():
            cols = [np.concatenate([b, *c]) for b, c in zip(back, zip(*held))]
            keep = _some(*cols, number)
            return [c[keep] for c in cols]

        for r in rows:
            cols = np.frombuffer(r[3], "<u2").astype(np.int64), np.frombuffer(r[4], "<i8"), np.frombuffer(r[5], np.uint8)
            if r[1] == 2:
                parts.append(cols)
                continue
            held.append(cols)
            if sum(len(c[0]) for c in held) >= 1 << 19:
                back, held = fold(), []
        if held:
            back = fold()
        owner, member, fresh = (np.concatenate(c) for c in zip(*parts, back))
        order = np.lexsort((1 - fresh, member, owner))
        owner, member, fresh = owner[order], member[order], fresh[order]
        once = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(member) != 0)]) if len(owner) else np.zeros(0, bool)
        owner, member, fresh = owner[once], member[once], fresh[once]
        yield block, 2, block, owner.astype("<u2").tobytes(), member.astype("<i8").tobytes(), fresh.tobytes()
        wanted = np.unique(member)
        for to, who in _split(wanted >> PLACE, wanted):
            yield to, 3, block, _place_of(who).tobytes(), None, None

    def tell(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        x = scale = bars = None
        for r in rows:
            if r[1] == 0:
                x = _unpacked(r[3], r[2])
                scale = np.abs(x).max(1)
                x = (x / scale[:, None]).astype("<f2")  # half precision chooses candidates; answers are scored anew
                scale = scale.astype("<f4")
            elif r[1] == 1:
                bars = np.frombuffer(r[3], "<f4")
            elif r[1] == 2:
                yield r
            else:
                at = np.frombuffer(r[3], "<u2")
                yield r[2], 4, block, r[3], x[at].tobytes(), scale[at].tobytes() + bars[at].tobytes()

    def join(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        owner = member = fresh = np.zeros(0, np.int64)
        names, vecs, bars = [], [], []
        for r in rows:
            if r[1] == 2:
                owner, member, fresh = np.frombuffer(r[3], "<u2").astype(np.int64), np.frombuffer(r[4], "<i8"), np.frombuffer(r[5], bool)
                continue
            at = np.frombuffer(r[3], "<u2")
            names.append((r[2] << PLACE) + at.astype(np.int64))
            scale, bar = np.frombuffer(r[5], "<f4").reshape(2, -1)
            vecs.append(np.frombuffer(r[4], "<f2").reshape(len(at), -1) * scale[:, None])
            bars.append(bar)
        if names:
            yield from local_join(block, owner, member, fresh, *map(np.concatenate, (names, vecs, bars)))

    def take(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        near, score, fresh = _opened(next(rows))
        yield from _state(block, *_merged(near, score, fresh & ~drawn(near, fresh, (block, number)), rows))

    vectors, lists, bars = held.where("kind = 0"), state.where("kind = 0"), state.where("kind = 1")
    asked = _step(ask, spread, _step(draw, spread, lists))
    told = _step(tell, spread, vectors, bars, asked)
    return _step(take, spread, lists, _step(join, spread, told))


def local_join(block: int, owner: np.ndarray, member: np.ndarray, fresh: np.ndarray, names: np.ndarray, vecs: np.ndarray, bars: np.ndarray, some: int = 256) -> Iterator[tuple]:
    """Candidates from the pairs, one of them fresh, of each owner's members: those that beat their target's bar."""
    order = np.argsort(names)
    names, vecs, bars = names[order], vecs[order], bars[order]
    of = np.searchsorted(names, member)
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    size = np.diff(np.concatenate([first, [len(owner)]]))
    by = np.argsort(size, kind="stable")
    kept, loose, held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.float32)], [], 0

    def fold():
        t, m, s = (np.concatenate(c) for c in zip(kept, *loose))
        keep = best(t, m, s, SENT)
        return [t[keep], m[keep], s[keep]]

    for at in range(0, len(by), some):
        mine = by[at : at + some]
        width = int(size[mine].max())
        place = first[mine][:, None] + np.minimum(np.arange(width), size[mine][:, None] - 1)
        real = np.arange(width) < size[mine][:, None]
        group, new = of[place], fresh[place] & real
        x = vecs[group]
        s = np.matmul(x, x.transpose(0, 2, 1))
        open_ = (new[:, :, None] | new[:, None, :]) & real[:, :, None] & real[:, None, :] & (s > bars[group][:, :, None])
        open_ &= group[:, :, None] != group[:, None, :]
        o, a, b = np.nonzero(open_)
        loose.append((group[o, a], group[o, b], s[o, a, b]))
        held += len(o)
        if held >= 1 << 20:
            kept, loose, held = fold(), [], 0
    t, m, s = fold() if loose else kept
    yield from _candidates(names[t], names[m], s, block)


def build(held: DataFrame, forest: tuple, n: int, spread: int, cell: int = CELL, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph as states of blocks: rounds until the changes die out."""
    spark = held.sparkSession
    state, path = written(start(held, forest, n, spread, cell), "nn-graph")
    for number in range(rounds if n > 1 else 0):
        after, at = written(one_round(held, state, spread, number), "nn-graph")
        delete(spark, path)
        state, path = after, at
        spark.sparkContext._jvm.System.gc()  # lets Spark drop the exchanges of the round from the executors' disks
        if (state.where("kind = 0").agg(F.sum("frm")).first()[0] or 0) < SETTLED * n * WIDTH:
            break
    return state


# --- greedy search -------------------------------------------------------------------------------------------------------


def _pool(block: int, who: np.ndarray, ids: np.ndarray, score: np.ndarray, done: np.ndarray) -> tuple:
    """kind 0 of a block that has queries: the queries' places, the pools' numbers (-1: free), scores, what is expanded."""
    left = int(((ids >= 0) & ~done).sum())
    return block, 0, left, who.astype("<u2").tobytes(), ids.astype("<i8").tobytes(), score.astype("<f8").tobytes() + done.astype(np.uint8).tobytes()


def _pool_opened(row: tuple) -> tuple:
    who = np.frombuffer(row[3], "<u2").astype(np.int64)
    shape, cut = (len(who), -1), len(row[5]) // 9 * 8
    return who, np.frombuffer(row[4], "<i8").reshape(shape), np.frombuffer(row[5][:cut], "<f8").reshape(shape), np.frombuffer(row[5][cut:], bool).reshape(shape)


def _to_score(block: int, query: np.ndarray, member: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
    """Questions for scores: a query's vector goes once to a block."""
    for to, q, m in _split(member >> PLACE, query, member):
        own, of = np.unique(q, return_inverse=True)
        head = len(own).to_bytes(4, "little") + own.astype("<u2").tobytes()
        yield to, 3, block, of.astype("<u2").tobytes(), _place_of(m).tobytes(), head + x[own].astype("<f8").tobytes()


def _scored(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    x = None
    for r in rows:
        if r[1] == 0:
            x = _unpacked(r[3], r[2])
            continue
        n = int.from_bytes(r[5][:4], "little")
        own = np.frombuffer(r[5][4 : 4 + 2 * n], "<u2")
        vecs = np.frombuffer(r[5][4 + 2 * n :], "<f8").reshape(n, -1)
        of, at = np.frombuffer(r[3], "<u2"), np.frombuffer(r[4], "<u2")
        s = np.concatenate([(x[at[k : k + 8192]] * vecs[of[k : k + 8192]]).sum(1) for k in range(0, len(at), 8192)])
        yield r[2], 4, block, own[of].tobytes(), ((block << PLACE) + at.astype("<i8")).tobytes(), s.tobytes()


def _filled(pool: tuple, rows: Iterator[tuple]) -> tuple:
    """Pools after scores came: the best ``POOL`` of each, in order of score and then number."""
    who, ids, score, done = pool
    at, k = np.nonzero(ids >= 0)
    told = list(rows)
    place = np.zeros(1 << PLACE, np.int64)
    place[who] = np.arange(len(who))
    t = np.concatenate([at, *(place[np.frombuffer(r[3], "<u2")] for r in told)])
    m = np.concatenate([ids[at, k], *(np.frombuffer(r[4], "<i8") for r in told)])
    s = np.concatenate([score[at, k], *(np.frombuffer(r[5], "<f8") for r in told)])
    d = np.concatenate([np.ones(len(at), bool), np.zeros(len(t) - len(at), bool)])  # what was in the pool is expanded by now
    order = np.lexsort((m, -s, t))
    rank = np.arange(len(t)) - np.searchsorted(t[order], t[order])
    order, rank = order[rank < POOL], rank[rank < POOL]
    out = np.full((len(who), POOL), -1), np.full((len(who), POOL), -np.inf), np.zeros((len(who), POOL), bool)
    for x, v in zip(out, (m, s, d)):
        x[t[order], rank] = v[order]
    return who, *out


def _begin(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows: vectors (0), ids (1), neighbours (2). The pools are empty; each query's node and neighbours are to be scored."""
    x = who = None
    for r in rows:
        if r[1] == 0:
            x = _unpacked(r[3], r[2])
        elif r[1] == 1:
            who = np.flatnonzero(np.frombuffer(r[5], np.uint8))
        elif len(who):
            near = np.concatenate([_opened(r)[0][who], ((block << PLACE) + who)[:, None]], axis=1)
            at, k = np.nonzero(near >= 0)
            yield _pool(block, who, np.zeros((len(who), 0), np.int64), np.zeros((len(who), 0)), np.zeros((len(who), 0), bool))
            yield from _to_score(block, who[at], near[at, k], x)


def _keep_pool(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    yield _pool(block, *_filled(_pool_opened(next(rows)), rows))


def _expand(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    for r in rows:
        who, ids, _, done = _pool_opened(r)
        at, k = np.nonzero((ids >= 0) & ~done)
        for to, q, m in _split(ids[at, k] >> PLACE, who[at], ids[at, k]):
            yield to, 3, block, q.astype("<u2").tobytes(), _place_of(m).tobytes(), None


def _neighbours(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    near = None
    for r in rows:
        if r[1] == 0:
            near = _opened(r)[0]
            continue
        q, at = np.frombuffer(r[3], "<u2"), np.frombuffer(r[4], "<u2")
        found = near[at]
        k, j = np.nonzero(found >= 0)
        pairs = np.unique(np.stack([q[k].astype(np.int64), found[k, j]]), axis=1)
        yield r[2], 4, block, pairs[0].astype("<u2").tobytes(), pairs[1].astype("<i8").tobytes(), None


def _unseen(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows: pools (0), vectors (1), neighbours of what was expanded (4): those not in the pools are to be scored."""
    pool, x, told = None, None, []
    for r in rows:
        if r[1] == 0:
            pool = r
        elif r[1] == 1:
            x = _unpacked(r[3], r[2]) if pool else None
        else:
            told.append((np.frombuffer(r[3], "<u2").astype(np.int64), np.frombuffer(r[4], "<i8")))
    if pool is None:
        return
    who, ids, _, _ = _pool_opened(pool)
    yield pool
    if told:
        q, m = (np.concatenate(c) for c in zip(*told))
        at, k = np.nonzero(ids >= 0)
        known = np.stack([who[at], ids[at, k]])
        every = np.concatenate([known, np.stack([q, m])], axis=1)
        order = np.lexsort((np.arange(every.shape[1]), every[1], every[0]))
        every = every[:, order]
        first = np.concatenate([[True], (np.diff(every[0]) != 0) | (np.diff(every[1]) != 0)])
        fresh = every[:, first & (order >= known.shape[1])]
        yield from _to_score(block, fresh[0], fresh[1], x)


FOUND = "query_id long, node long, rank int, vec_id long, score double"


def _answers(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows: the block's ids (0), ids found (4). A row for each answer of each asked id, or of a node with too many ids."""
    own, told = None, []
    for r in rows:
        if r[1] == 0:
            own = r
        else:
            told.append((np.frombuffer(r[3], "<u2").astype(np.int64), np.frombuffer(r[4], "<i8"), np.frombuffer(r[5], "<f8")))
    q, i, s = (np.concatenate(c) for c in zip(*told))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    ends = np.cumsum(np.frombuffer(own[3], np.uint8).astype(np.int64))
    ids = np.frombuffer(own[4], "<i8")
    for k in np.unique(q).tolist():
        a, b = np.searchsorted(q, [k, k + 1])
        near = list(zip(i[a:b].tolist(), s[a:b].tolist()))
        mine = ids[(ends[k - 1] if k else 0) : ends[k]].tolist()
        if len(mine) > TOP:
            for rank, (c, score) in enumerate(near[: TOP + 1]):
                yield None, mine[0], rank, c, score
            continue
        for asked in mine:
            for rank, (c, score) in enumerate([n for n in near[: TOP + 1] if n[0] != asked][:TOP]):
                yield asked, None, rank + 1, c, score


def _named(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows: the block's ids (0), nodes found (3): the ids of each, with its score."""
    counts = starts = ids = None
    for r in rows:
        if r[1] == 0:
            counts, ids = np.frombuffer(r[3], np.uint8).astype(np.int64), np.frombuffer(r[4], "<i8")
            starts = np.cumsum(counts) - counts
            continue
        q, at, s = np.frombuffer(r[3], "<u2"), np.frombuffer(r[4], "<u2"), np.frombuffer(r[5], "<f8")
        n = counts[at]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield r[2], 4, block, np.repeat(q, n).tobytes(), ids[np.repeat(starts[at], n) + within].tobytes(), np.repeat(s, n).tobytes()


def _tops(block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    for r in rows:
        who, ids, score, _ = _pool_opened(r)
        at, k = np.nonzero(ids[:, : TOP + 1] >= 0)
        for to, q, m, s in _split(ids[at, k] >> PLACE, who[at], ids[at, k], score[at, k]):
            yield to, 3, block, q.astype("<u2").tobytes(), _place_of(m).tobytes(), s.astype("<f8").tobytes()


def greedy(held: DataFrame, state: DataFrame, spread: int, hops: int = HOPS) -> DataFrame:
    """``FOUND`` rows: the ``TOP`` nearest found of each asked id; of a node of many ids, for the node."""
    spark = held.sparkSession
    vectors, ids, lists = held.where("kind = 0"), held.where("kind = 1"), state.where("kind = 0")
    begun, path = written(_step(_begin, spread, vectors, ids, _kind(state, 0, 2)), "nn-pools")
    scores = _step(_scored, spread, vectors, begun.where("kind = 3"))
    pools, at = written(_step(_keep_pool, spread, begun.where("kind = 0"), scores), "nn-pools")
    delete(spark, path)
    path = at
    for _ in range(hops):
        if not pools.agg(F.sum("frm")).first()[0]:
            break
        told = _step(_neighbours, spread, lists, _step(_expand, spread, pools))
        asked, mid = written(_step(_unseen, spread, pools, vectors.withColumn("kind", F.lit(1)), told), "nn-pools")
        scores = _step(_scored, spread, vectors, asked.where("kind = 3"))
        after, at = written(_step(_keep_pool, spread, asked.where("kind = 0"), scores), "nn-pools")
        for old in (path, mid):
            delete(spark, old)
        pools, path = after, at
        spark.sparkContext._jvm.System.gc()
    named = _step(_named, spread, ids.withColumn("kind", F.lit(0)), _step(_tops, spread, pools))
    asking = ids.withColumn("kind", F.lit(0)).join(pools.select("block"), "block", "left_semi")
    return _step(_answers, spread, asking, named, ddl=FOUND)


def search(vectors: DataFrame, every: int = 20, values: int = VALUES, cell: int = CELL, rounds: int = ROUNDS, hops: int = HOPS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``TOP`` nearest found of each row whose id is divisible by ``every``.

    ``values`` bounds the components that a block holds; the other parameters are those named above.
    """
    spark: SparkSession = vectors.sparkSession
    nodes, _ = written(nodes_of(vectors, every), "nn-nodes")
    if nodes.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def answers() -> DataFrame:
        held, forest, n, spread = lay_out(nodes, values)
        return greedy(held, build(held, forest, n, spread, cell, rounds), spread, hops)

    found = settled(spark, "nn-answers", answers)
    out = ["query_id", "rank", "vec_id", "score"]
    plain = found.where((F.col("query_id") % every) == 0).select(*out)
    # the queries of very common vectors: light rows, dealt to as many parts as there are salts
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    asked = vectors.select(F.col("vec_id").cast("long").alias("query_id"), vec.alias("vec")).where(F.col("query_id") % every == 0)
    asked = asked.select("query_id", F.xxhash64("vec").alias("h"), F.xxhash64("vec", F.lit(1)).alias("g")).distinct()
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)))
    near = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), "vec_id", "score"))).alias("near")
    common = nodes.where(F.size("ids") > TOP).select("node", "h", "g").join(found.where("node is not null").groupBy("node").agg(near), "node")
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    mine = asked.join(common, ["h", "g", "salt"]).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, TOP).alias("near"))
    many = mine.select("query_id", F.posexplode("near").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
    return plain.union(many.select(*out))
