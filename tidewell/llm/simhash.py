"""SimHash near-duplicates by pigeonhole blocks.

A text is lower-cased (A-Z), cut to words at ASCII white space and read as word shingles, repeats included; a text of
fewer words is one shingle, one without words has fingerprint zero. Bit ``i`` of a fingerprint is set if it is set in
over half of the shingles' hashes. Documents of equal fingerprints are one node, so copies cost nothing further.

Null texts count as empty and link like other equal texts. Null ids keep their fingerprint; a component whose ids are
all null has a null id. Repeated ids and rows are rows of their own in ``link``. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import arrow_schema, batch_of, id_text, map_batches, settled, unused, written
from tidewell.llm.components import components

SEED = 42
#: Fingerprints in a block's group up to which all pairs are compared; larger groups are linked through midpoints.
PAIRS = 32


def signed_hash(raw: bytes) -> int:
    """As Spark's ``xxhash64`` of a string."""
    h = xxhash.xxh64_intdigest(raw, SEED)
    return h - (1 << 64) if h >> 63 else h


def shingle_hashes(text: str, size: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, of = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.array([of(line[a:b], SEED) for a, b in zip(starts, ends[min(size, len(words)) - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> bytes:
    """The bits set in over half of the hashes, each a row of 64-bit words, as little-endian bytes."""
    if not len(hashes):
        return bytes(8 * (hashes.shape[1] if hashes.ndim > 1 else 1))
    raw = hashes.reshape(len(hashes), -1).view(np.uint8)
    total = np.zeros(raw.shape[1] * 8, np.int64)
    for at in range(0, len(raw), 4096):
        total += np.unpackbits(raw[at : at + 4096], axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * total > len(raw), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp``: the 64-bit fingerprint of every whole text, as a signed long."""
    ddl = "doc_id long, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [int.from_bytes(majority(shingle_hashes(t, size)), "little", signed=True) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], schema=arrow_schema(ddl))

    return map_batches(id_text(docs), run, ddl)


def block_masks(distance: int, blocks: int) -> list[int]:
    """Of each choice of ``blocks - distance`` blocks of the 64 bits, a mask: pairs within ``distance`` agree on one."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(parts, blocks - distance)]


def near_pairs(fps: DataFrame, distance: int = 2, blocks: int = 5, pairs: int = PAIRS) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints that connect all pairs within ``distance`` (1 or 2).

    Fingerprints join on each choice of blocks. In a group of up to ``pairs`` all pairs are verified. In a larger group
    each fingerprint names those within one bit of itself among the bits that the group leaves open, and links to the
    least that names the same one: two fingerprints within two bits name a midpoint in common, and any two that name
    one are within two bits. The links are as many as the names, not the pairs, and connect the same fingerprints.
    """
    if distance not in (1, 2):
        raise ValueError("distance is 1 or 2")
    masks = block_masks(distance, blocks)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("j"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("b")).select("fp", "b.j", "b.key")
    groups = keyed.groupBy("j", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(groups, ["j", "key"])
    few = shared.where(F.col("n") <= pairs)
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    verified = few.select("j", "key", F.col("fp").alias("u")).join(few.select("j", "key", F.col("fp").alias("v")), ["j", "key"]).where((F.col("u") > F.col("v")) & close("u", "v")).select("u", "v")
    if distance == 2:
        open_bits = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64) if not (m >> i) & 1]) for m in masks])
        named = shared.where(F.col("n") > pairs).select("j", "key", "fp", F.explode(F.element_at(open_bits, F.col("j") + 1)).alias("bit")).select("j", "key", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("name"))
        least = named.groupBy("j", "name").agg(F.min("fp").alias("v"), F.count("*").alias("c")).where("c > 1").select("j", "name", "v")
        verified = verified.union(named.join(least, ["j", "name"]).where("fp <> v").select(F.col("fp").alias("u"), "v"))
    else:
        many = shared.where(F.col("n") > pairs).select("fp").distinct()
        flips = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])).alias("v"))
        verified = verified.union(flips.where("v < fp").join(fps.select(F.col("fp").alias("v")), "v", "left_semi").select(F.col("fp").alias("u"), "v"))
    return verified.distinct()


def link(docs: DataFrame, size: int = 3, distance: int = 2, blocks: int = 5) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id reachable through near fingerprints."""
    return settled(docs.sparkSession, "linked", lambda: _link(docs, size, distance, blocks))


def _link(docs: DataFrame, size: int, distance: int, blocks: int) -> DataFrame:
    marked, _ = written(fingerprints(docs, size), "fingerprints")  # texts are read and hashed once
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_pairs(distinct, distance, blocks))
    nodes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = nodes.join(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


# --- near copies: similarity well below what two bits of 64 can tell --------------------------------------------------

#: 64-bit words of a wide fingerprint.
WORDS = 4
#: Fixed odd factors that spread a shingle's hash to further words.
SPREAD = np.array([1] + [0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1 for k in range(1, WORDS)], np.uint64)
#: Least bits of a band, chance fingerprints of one (a power of 2), and share of pairs at the similarity that no band joins.
BAND, CROWD, MISSED = 16, 3, 0.01
#: Standard deviations by which a candidate may differ in more bits than its similarity expects.
SLACK = 2.5
#: Fingerprints of a band's group that one task compares, leaders of a larger group.
GROUP, LEADERS = 1024, 8
#: Size up to which all near pairs of a group are candidates; those of a larger group are the edges of a shortest tree.
SMALL = 16
#: Hashes of a share of a set of shingles, about.
SHARE = 4096
#: Hashes that one matrix product counts.
COLUMNS = 4096
#: Rows of a list of keys, a few numbers each, up to which it is broadcast.
FEW = 200_000


def differing(similarity: float) -> float:
    """The share of bits in which shingle sets of that Jaccard similarity are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def allowed(similarity: float, bits: int = 64 * WORDS) -> int:
    """Differing bits up to which a pair is a candidate."""
    p = differing(similarity)
    return int(bits * p + SLACK * (bits * p * (1 - p)) ** 0.5)


def bands_for(nodes: int, similarity: float) -> np.ndarray:
    """The bits of each band, a row for each: wide enough for so many fingerprints, as many as the similarity needs."""
    width = min(60, max(BAND, max(1, nodes).bit_length() - CROWD))
    shared = (1 - differing(similarity)) ** width
    count = int(np.ceil(np.log(MISSED) / np.log1p(-shared))) if shared < 1 else 1
    rng = np.random.default_rng(SEED)
    return np.array([rng.permutation(64 * WORDS)[:width] for _ in range(count)])


class _WordHashes(dict):
    """Hashes of words by word, emptied when it holds as many as ``WORD_MEMO``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


WORD_MEMO = 200_000
_word_hashes = _WordHashes()
#: An odd factor: a shingle's hash is a polynomial of its words' hashes in it.
STEP = np.uint64(0x9E3779B97F4A7C15)


def word_shingles(text: str, size: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, from one hash of each word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out *= STEP
        out += h[k : len(h) - size + 1 + k]
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def wide(text: str, size: int) -> tuple[bytes, int]:
    """A text's wide fingerprint, and how many distinct shingles it has."""
    h = word_shingles(text, size)
    if not len(h):
        return bytes(8 * WORDS), 0
    total = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(h), 255):  # so many ones fit a byte
        x = h[at : at + 255, None] * SPREAD[None, :]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        total += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little").tobytes(), len(h)


def shortest_tree(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """The edges of a shortest spanning forest of the rows, by Hamming distance up to ``bits``, grown from row to row."""
    n, out = len(fps), []
    near, frm, left = np.full(n, 1 << 20), np.zeros(n, int), np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        d = np.bitwise_count(fps ^ fps[at]).sum(1, dtype=np.int64)
        closer = left & (d < near)
        near[closer], frm[closer] = d[closer], at
        at = int(np.where(left, near, 1 << 21).argmin())
        if near[at] <= bits:
            out.append((int(frm[at]), at))
    return out


def group_pairs(group: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """Candidate pairs of rows of each run of equal ``group``: all near ones of a small run, a shortest forest of a larger one."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    sizes, out = np.diff(starts), []
    left = np.repeat(starts[1:], sizes) - np.arange(len(group)) - 1  # rows of the run that follow
    rows = np.flatnonzero(np.repeat(sizes, sizes) <= SMALL)
    for shift in range(1, SMALL):
        rows = rows[left[rows] >= shift]
        if not len(rows):
            break
        near = rows[np.bitwise_count(fps[rows] ^ fps[rows + shift]).sum(1, dtype=np.int64) <= bits]
        out.append(np.stack([near, near + shift], axis=1))
    for k in np.flatnonzero(sizes > SMALL).tolist():
        a = int(starts[k])
        out.append(a + np.array(shortest_tree(fps[a : starts[k + 1]], bits), np.int64).reshape(-1, 2))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets have in common, as a square matrix. A set holds a hash once."""
    n = len(sets)
    of, h = np.repeat(np.arange(n), [len(x) for x in sets]), np.concatenate(sets)
    order = h.argsort(kind="stable")
    of, h = of[order], h[order]
    starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
    sizes = np.diff(starts)
    out = np.zeros((n, n), np.float32)
    # a hash that few sets have: pair by pair; the others: by matrix products
    left = np.repeat(starts[1:], sizes) - np.arange(len(h)) - 1
    rows = np.flatnonzero(np.repeat(sizes, sizes) <= SMALL)
    for shift in range(1, SMALL):
        rows = rows[left[rows] >= shift]
        if not len(rows):
            break
        out += np.bincount(of[rows] * n + of[rows + shift], minlength=n * n).reshape(n, n)
    out += out.T
    often = np.flatnonzero(sizes > SMALL)
    for at in range(0, len(often), COLUMNS):
        runs = often[at : at + COLUMNS]
        has = np.zeros((n, len(runs)), np.float32)
        inside = np.concatenate([np.arange(a, b) for a, b in zip(starts[runs].tolist(), starts[runs + 1].tolist())])
        has[of[inside], np.repeat(np.arange(len(runs)), sizes[runs])] = 1
        out += has @ has.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def joining(like: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs of rows that the symmetric matrix ``like`` marks, a forest that joins the roots that all of them join."""
    seen, out = np.zeros(len(root), bool), []
    for start in range(len(root)):
        if not seen[start]:
            new = root == root[start]
            seen |= new
            todo = np.flatnonzero(new).tolist()
            while todo:
                at = todo.pop()
                for to in np.flatnonzero(like[at] & ~seen).tolist():
                    if not seen[to]:
                        out.append((at, to))
                        new = root == root[to]
                        seen |= new
                        todo += np.flatnonzero(new).tolist()
    return out


LINK_DDL = "u long, v long"


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def _links(bits: int):
    """Over rows ``g, rep, fp`` in order of ``g``: the candidate pairs of each group."""

    def found(t: pa.Table) -> pa.RecordBatch:
        pairs = t.column(1).to_numpy()[group_pairs(t.column(0).to_numpy(), _words(t.column(2)), bits)]
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], schema=arrow_schema(LINK_DDL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 16 * GROUP:
                t = pa.Table.from_batches(held).combine_chunks()
                g = t.column(0).to_numpy()
                whole = int(np.searchsorted(g, g[-1]))  # the last run may go on
                if whole:
                    yield found(t.slice(0, whole))
                held, rows = t.slice(whole).to_batches(), len(g) - whole
        if rows:
            yield found(pa.Table.from_batches(held))

    return run


def _with(rows: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """A join with a list that is broadcast only if it has no more than ``FEW`` rows."""
    return rows.join(F.broadcast(few) if few.count() <= FEW else few, key, how)


def _led(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``key, rep, fp, v, d`` of the rows of crowded groups: ``v`` is the nearest leader, ``d`` the bits in which it differs.

    Each group has ``LEADERS`` members as leaders, the least by as many hashes; groups that have most members in common so
    have most leaders in common, and a member's links are few. Its rows and copies of its leaders are dealt to as many
    parts as keep a part within ``GROUP`` rows.
    """
    parts = F.ceil(F.col("n") / GROUP).cast("long")
    crowd = _with(rows, sizes, "key", "inner").withColumn("part", F.pmod(F.xxhash64("rep"), parts))
    draw = [F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("o"), "rep", "fp")).alias(f"l{k}") for k in range(LEADERS)]
    leaders = crowd.groupBy("key", "n").agg(*draw).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    leaders = leaders.select("key", "part", F.array(*[F.col(f"l{k}.rep") for k in range(LEADERS)]).alias("reps"), F.array(*[F.col(f"l{k}.fp") for k in range(LEADERS)]).alias("fps"))
    ddl = "key long, rep long, fp binary, v long, d long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, lead = _words(b.column(2)), _words(b.column(4).flatten()).reshape(b.num_rows, LEADERS, WORDS)
                d = np.bitwise_count(own[:, None, :] ^ lead).sum(2, dtype=np.int64)
                best = d.argmin(1)
                at = np.arange(b.num_rows)
                v = b.column(3).flatten().to_numpy().reshape(-1, LEADERS)[at, best]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(v, pa.int64()), pa.array(d[at, best])], schema=arrow_schema(ddl))

    joined = crowd.join(leaders, ["key", "part"]).select("key", "rep", "fp", "reps", "fps")
    return map_batches(joined, run, ddl)


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows ``key, n, ..`` with a hash ``g`` in place of key and ``n``: of a group of over ``GROUP``, part against part."""
    parts = F.when(F.col("n") > GROUP, F.ceil(2 * F.col("n") / GROUP)).otherwise(1).cast("long")
    placed = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep", "key"), F.col("parts")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: o != F.col("part"))
    pair = lambda o: F.concat_ws(" ", F.col("key"), F.least("part", o), F.greatest("part", o))
    pairs = F.when(F.col("parts") == 1, F.array(F.concat_ws(" ", F.col("key")))).otherwise(F.transform(others, pair))
    left = [c for c in rows.columns if c not in ("key", "n")]
    return placed.select(F.explode(pairs).alias("g"), *left).withColumn("g", F.xxhash64("g"))


def candidates(banded: DataFrame, similarity: float) -> DataFrame:
    """``u, v, asked``: pairs ``u < v`` of ``rep, fp, keys`` nodes, those ``asked`` likely to have the similarity. They connect most that have it.

    Fingerprints meet where they agree on all bits of a band; the task that holds a group returns its near pairs, or the
    edges of a shortest forest. In a crowded group (copies of one text with small changes are in one in every band) each
    member links to its nearest leader; those that are near none are compared with each other, part against part, so
    that no task holds more than ``GROUP`` of them. What one band's leaders leave apart another's may join: a band's
    groups, and so its leaders, differ from another's.

    All pairs together, asked or not, connect every two nodes of one band's group that are within ``bits``: the forest of
    a group does; in a crowded group so do those near no leader, and all within twice the bits of a leader are tied to one
    node, as both of a pair are of which one is near a leader.
    """
    return settled(banded.sparkSession, "candidates", lambda: _candidates(banded, similarity))


def _banded(nodes: DataFrame, similarity: float) -> DataFrame:
    """``rep, fp, keys``, written: of each node, what its fingerprint is in each band."""
    bands = bands_for(nodes.count(), similarity)
    ddl = "rep long, fp binary, keys array<long>"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(bands.shape[1], dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x = np.unpackbits(_words(b.column(1)).view(np.uint8), axis=1, bitorder="little")
                # a band's values take the place above its number
                value = np.stack([(x[:, band] @ power) * len(bands) + k for k, band in enumerate(bands)], axis=1)
                every = pa.ListArray.from_arrays(pa.array(np.arange(0, value.size + 1, len(bands)), pa.int32()), pa.array(value.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), every], schema=arrow_schema(ddl))

    return written(map_batches(nodes.select("rep", "fp"), keys, ddl), "bands")[0]


def unsettled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, rep, root`` of the nodes that ``met`` connects to one of another root, unless each two of what it connects were asked; ``key`` names what it connects."""
    nodes, _ = written(components(met).withColumnsRenamed({"node": "rep", "root": "key"}).join(roots, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root")), "met")
    asked = met.where("asked").join(nodes.select("key", F.col("rep").alias("u")), "u").groupBy("key").agg(F.count("*").alias("asked"))
    some = nodes.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    mixed, _ = written(some.join(asked, "key", "left").where(2 * F.coalesce("asked", F.lit(0)) < F.col("n") * (F.col("n") - 1)).select("key"), "mixed")
    return _with(nodes, mixed, "key", "inner").select("key", "rep", "root")


def joined(nodes: DataFrame, texts: DataFrame, size: int, similarity: float, share: int | None = None) -> DataFrame:
    """Pairs ``u, v`` of one ``key`` whose texts have the similarity: not all, but as many as join all the roots that any such pair joins.

    ``nodes`` has ``key, rep, root, n``, of each text the size of its set, and ``texts`` has ``rep, text``. Two sets are
    compared in the task that holds both, ``GROUP`` nodes of a key at most, and a task returns a forest of the roots: rows
    are as many as nodes, not pairs. Sets come in shares by ranges of the hash, as many as the key's largest set needs.
    """
    share = share or SHARE
    keys = nodes.groupBy("key").agg(F.count("*").alias("members"), F.max("n").alias("most"))
    placed = nodes.join(keys, "key")
    dealt, _ = written(_dealt(placed.select("key", F.col("members").alias("n"), "rep", "root", F.col("n").alias("own"))), "dealt")
    cut = texts.join(placed.select("rep", _bits(F.col("most"), share).alias("p")), "rep")
    ddl = "rep long, k int, shingles binary"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {f.name: [] for f in arrow_schema(ddl)}
        held = 0
        for b in batches:
            for rep, text, p in zip(*[c.to_pylist() for c in b.columns]):
                h = word_shingles(text, size)
                for k, part in shares_of(h, p):
                    for name, v in (("rep", rep), ("k", k), ("shingles", part)):
                        cols[name].append(v)
                held += len(h)
                if held >= 1 << 18:
                    yield batch_of(cols, ddl)
                    cols, held = {n: [] for n in cols}, 0
        if held:
            yield batch_of(cols, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, group = None, _Group(similarity)
        for b in batches:
            if not b.num_rows:
                continue
            g, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            ends = [*(np.flatnonzero((g[1:] != g[:-1]) | (k[1:] != k[:-1])) + 1).tolist(), len(g)]
            for start, end in zip([0, *ends], ends):
                now = int(g[start]), int(k[start])
                if now != at and held:
                    group.add(held)
                    held = []
                if at and now[0] != at[0]:
                    yield group.links()
                    group = _Group(similarity)
                at = now
                held.append(b.slice(start, end - start))
        if held:
            group.add(held)
            yield group.links()

    rows = _with(map_batches(cut.select("rep", "text", "p"), sets, ddl), dealt, "rep", "inner").select("g", "k", "rep", "root", "own", "shingles")
    return map_batches(rows.repartition("g").sortWithinPartitions("g", "k", "rep"), run, LINK_DDL).distinct()


class _Group:
    """What the sets of one group's nodes have in common, added up share by share."""

    def __init__(self, similarity: float):
        self.similarity, self.place, self.root, self.own, self.both = similarity, {}, [], [], np.zeros((0, 0), np.float32)

    def add(self, share: list[pa.RecordBatch]) -> None:
        """Rows ``g, k, rep, root, own, shingles`` of one share."""
        at, sets = [], []
        for b in share:
            for rep, root, own, raw in zip(*[b.column(c).to_pylist() for c in (2, 3, 4, 5)]):
                if rep not in self.place:
                    self.place[rep] = len(self.place)
                    self.root.append(root)
                    self.own.append(own)
                at.append(self.place[rep])
                sets.append(np.frombuffer(raw, np.uint64))
        more = len(self.place) - len(self.both)
        self.both = np.pad(self.both, (0, more))
        self.both[np.ix_(at, at)] += shared_counts(sets)

    def links(self) -> pa.RecordBatch:
        own = np.array(self.own, np.int64)
        both = self.both.astype(np.int64)
        like = both >= self.similarity * (own[:, None] + own[None, :] - both)
        pairs = np.array(list(self.place), np.int64)[np.array(joining(like, np.array(self.root, np.int64)), np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], schema=arrow_schema(LINK_DDL))


def _candidates(banded: DataFrame, similarity: float) -> DataFrame:
    bits = allowed(similarity)
    keyed = banded.select("rep", "fp", F.explode("keys").alias("key"))
    sizes, _ = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP), "crowds")
    usual = _with(keyed, sizes.select("key"), "key", "left_anti").select(F.col("key").alias("g"), "rep", "fp")
    asked = F.lit(True).alias("asked")
    found = map_batches(usual.repartition("g").sortWithinPartitions("g", "rep"), _links(bits), LINK_DDL).select("u", "v", asked)
    if not sizes.isEmpty():
        led, _ = written(_led(keyed, sizes), "led")
        low = led.groupBy("key").agg(F.min("v").alias("low"))
        for rows, v, is_asked in ((led.where(F.col("d") <= bits), "v", asked), (_with(led.where(F.col("d") <= 2 * bits), low, "key", "inner"), "low", F.lit(False).alias("asked"))):
            found = found.union(rows.select(F.least("rep", v).alias("u"), F.greatest("rep", v).alias("v"), is_asked))
        rest = led.where(F.col("d") > bits).select("key", "rep", "fp")
        dealt = _dealt(rest.join(rest.groupBy("key").agg(F.count("*").alias("n")), "key")).select("g", "rep", "fp")
        found = found.union(map_batches(dealt.repartition("g").sortWithinPartitions("g", "rep"), _links(bits), LINK_DDL).select("u", "v", asked))
    return found.where("u <> v").groupBy("u", "v").agg(F.max("asked").alias("asked"))


def share_bits(n: int, share: int) -> int:
    """Bits that cut a set of ``n`` hashes to shares of about ``share`` at most."""
    return max(0, (n - 1) // share).bit_length()


def _bits(most: Column, share: int) -> Column:
    return F.when(most <= share, 0).otherwise(F.length(F.bin(F.floor((most - 1) / share)))).cast("int")


def shares_of(h: np.ndarray, p: int) -> Iterator[tuple[int, bytes]]:
    """The shares of ordered hashes that have any, by their first ``p`` bits."""
    ends = np.searchsorted(h, np.arange(1, 1 << p, dtype=np.uint64) << np.uint64(64 - p)) if p else []
    return ((k, part.tobytes()) for k, part in enumerate(np.split(h, ends)) if len(part))


def similar(pairs: DataFrame, texts: DataFrame, size: int, similarity: float, share: int = SHARE) -> DataFrame:
    """Those of the pairs ``u, v`` whose texts' sets of shingles have at least that Jaccard similarity.

    ``pairs`` has the sizes ``nu, nv`` of the sets and ``texts`` has ``rep, text``, one row for each. Sets are of 64-bit
    hashes. Sizes rule out pairs before a set is made; the sets of the others are cut by ranges of the hash to shares of
    about ``share``, counted share by share and added up, so that no row grows with a text.
    """
    most, least = F.greatest("nu", "nv"), F.least("nu", "nv")
    near = pairs.where(least >= similarity * most)
    asked = near.withColumn("p", _bits(most, share)).withColumn("k", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, p) - 1"))))
    ddl = "rep long, p int, k int, shingles binary"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {f.name: [] for f in arrow_schema(ddl)}
        held = 0
        for b in batches:
            for rep, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = word_shingles(text, size)
                # a set as large as one that this one can still be similar to is cut as finely
                for p in range(share_bits(len(h), share), share_bits(int(len(h) / similarity) + 1, share) + 1):
                    for k, part in shares_of(h, p):
                        for name, v in (("rep", rep), ("p", p), ("k", k), ("shingles", part)):
                            cols[name].append(v)
                    held += len(h)
                if held >= 1 << 18:
                    yield batch_of(cols, ddl)
                    cols, held = {n: [] for n in cols}, 0
        if held:
            yield batch_of(cols, ddl)

    counted_ddl = "u long, v long, nu long, nv long, both long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = []
            for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                z = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                z.sort(kind="stable")
                both.append(int((z[1:] == z[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(4)] + [pa.array(both, pa.int64())], schema=arrow_schema(counted_ddl))

    held, _ = written(map_batches(texts.select("rep", "text"), sets, ddl), "shingles")
    one = asked.join(held.withColumnsRenamed({"rep": "u", "shingles": "su"}), ["u", "p", "k"])
    two = one.join(held.withColumnsRenamed({"rep": "v", "shingles": "sv"}), ["v", "p", "k"])
    shares = map_batches(two.select("u", "v", "nu", "nv", "su", "sv"), count, counted_ddl)
    total = shares.groupBy("u", "v", "nu", "nv").agg(F.sum("both").alias("both"))
    return total.where(F.col("both") >= similarity * (F.col("nu") + F.col("nv") - F.col("both"))).select("u", "v")


def wide_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, mark, rep, root``: of every row, the hash of its text, its fingerprint's node and the root of its group.

    Texts of one wide fingerprint are one node, for which its first text speaks. Candidate pairs of nodes are linked if
    their sets of ``size``-word shingles have at least the Jaccard similarity. Fingerprints are written once, and the
    sets of those texts alone that are in a candidate pair.
    """
    return settled(docs.sparkSession, "groups", lambda: _wide_groups(docs, size, similarity))


def _wide_groups(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    ddl = "doc_id long, mark long, rep long, n long, fp binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            fps, sizes = zip(*[wide(t, size) for t in texts]) if texts else ((), ())
            cols = [signed_hash(t.encode("utf-8", "surrogatepass")) for t in texts], [signed_hash(f) for f in fps], sizes
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols], pa.array(fps, pa.binary())], schema=arrow_schema(ddl))

    marked, _ = written(map_batches(id_text(docs), run, ddl), "wide")
    banded = _banded(marked.groupBy("rep").agg(F.min("fp").alias("fp")), similarity)
    far = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    first = marked.groupBy("rep").agg(F.min(F.struct(far.alias("_id"), F.col("mark").alias("_mark"), "n")).alias("f")).select("rep", "f.*")
    named = id_text(docs).select(far.alias("_id"), F.xxhash64("text").alias("_mark"), "text")

    few = lambda asked: F.broadcast(asked) if asked.count() <= FEW else asked
    spoken = lambda asked: named.join(asked.select("_id", "_mark", "rep"), ["_id", "_mark"]).dropDuplicates(["rep"])
    met = candidates(banded, similarity)
    pairs = met.where("asked").select("u", "v")
    asked, _ = written(first.join(pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct(), "rep"), "asked")
    asked = few(asked)
    sized = pairs.join(asked.select(F.col("rep").alias("u"), F.col("n").alias("nu")), "u").join(asked.select(F.col("rep").alias("v"), F.col("n").alias("nv")), "v")
    roots, _ = written(components(similar(sized, spoken(asked), size, similarity)).withColumnRenamed("node", "rep"), "roots")
    # what forests and leaders left apart: every other pair of the nodes that the candidates connect, if it would join two roots
    left, _ = written(unsettled(met, roots).join(first, "rep"), "unsettled")
    if not left.isEmpty():
        more = joined(left.select("key", "rep", "root", "n"), spoken(few(left)), size, similarity)
        edges = roots.select(F.col("rep").alias("u"), F.col("root").alias("v")).union(more)
        roots = components(edges).withColumnRenamed("node", "rep")
    return marked.select("doc_id", "mark", "rep").join(roots, "rep", "left").select("doc_id", "mark", "rep", F.coalesce("root", "rep").alias("root"))


def keep_first(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of near-duplicates the row of smallest id (then of least text hash), with all columns of ``docs``.

    Null ids come last in a group. Rows that repeat a kept row in id and text go as well. Columns may have any names.
    """
    groups = wide_groups(docs, size, similarity)
    far, (i, m) = F.lit((1 << 63) - 1), unused(docs.columns, "id", "mark")
    kept = groups.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", far).alias(i), F.col("mark").alias(m))).alias("k")).select("k.*").distinct()
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    keyed = docs.withColumns({i: F.coalesce(docs["doc_id"].cast("long"), far), m: mark})
    return keyed.join(kept, [i, m], "left_semi").dropDuplicates([i, m]).drop(i, m)
