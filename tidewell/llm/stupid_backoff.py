"""Stupid-backoff language-model scores.

Words are runs of non-space ASCII characters or others, A-Z lower-cased. Every word and every n-gram of up to ``order``
words is counted over all documents, by a 64-bit hash; n-grams of 2 words and more that occur fewer than ``least`` times
are not in the model. A word's score is the log of its n-gram's count over its context's count, at the longest context
for which the model has the n-gram, times ``ALPHA`` for each word by which the context is shortened; without context it
is the word's share of all words. There is no vocabulary: nothing is kept that grows with the number of words but the
tables of n-grams, which are dealt out by hash.

Documents are grouped to blocks of bounded size. A block names its distinct n-grams, words among them, dealt out to
buckets by ranges of their hash; a bucket adds up the counts of its n-grams over all blocks, and answers each block in
the order of its question. So a frequent n-gram is one entry of a block, however often it occurs, and only packed hashes
and counts travel. Then each block sums its documents.

Null and empty texts have no words and score 0. Repeated rows and ids are scored, and counted, each for itself. An
empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import arrow_schema, batch_of, id_text, map_batches, partition_number, written

ALPHA = 0.4
#: Words of a block and n-grams of a bucket, about: bounds of a worker's memory.
BLOCK, BUCKET = 800_000, 2_000_000
SEED = 42
#: Words whose hashes a worker remembers.
WORD_MEMO = 200_000
#: An odd factor: an n-gram's hash is a polynomial of its words' hashes in it.
STEP = np.uint64(0x9E3779B97F4A7C15)


#: Bits of a hash beyond those that number all n-grams of the corpus: about 2^-SPARE of the n-grams share a hash.
SPARE = 20


def bits_for(total: int, order: int) -> int:
    return max(32, min(64, (max(1, total) * order).bit_length() + SPARE))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


class _Hashes(dict):
    """Hashes of words by word, of so many bits, emptied when it holds as many as ``WORD_MEMO``."""

    def __init__(self, bits: int):
        super().__init__()
        self.cut = 64 - bits

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED) >> self.cut
        return h


def _packed(x: np.ndarray) -> bytes:
    """Numbers as bytes: their count, then a compressed plane for each of the 8 bytes."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _opened(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], 8 * n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def _keys_packed(keys: np.ndarray) -> bytes:
    """As differences, which wrap where the order falls."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _keys_opened(raw: bytes) -> np.ndarray:
    return np.cumsum(_opened(raw), dtype=np.uint64)


def _by_count(counts: np.ndarray) -> np.ndarray:
    """Places in order of falling count."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


BLOCK_DDL = "block long, n long, doc_ids binary, nulls binary, lengths binary, words binary"


def _blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    hashes, block = _Hashes(bits), partition_number() << 32
    ids, rows, held = [], [], 0

    def close():
        raw = np.array([i or 0 for i in ids], "<i8")
        # the words of a block repeat: its distinct hashes in order with their counts, and of each word its rank by count
        every, of, counts = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        rank = np.empty(len(every), np.int64)
        rank[_by_count(counts)] = np.arange(len(every))
        packed = b"".join(len(x).to_bytes(8, "little") + x for x in (_keys_packed(every), _packed(counts), _packed(rank[of])))
        return batch_of({"block": [block], "n": [held], "doc_ids": [raw.tobytes()], "nulls": [bytes(i is None for i in ids)], "lengths": [np.array([len(r) for r in rows], "<u4").tobytes()], "words": [packed]}, BLOCK_DDL)

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = words(text)
            ids.append(i)
            rows.append(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)))
            held += len(w)
            if held >= BLOCK or len(rows) >= 4096:
                yield close()
                block, ids, rows, held = block + 1, [], [], 0
    if rows:
        yield close()


def _block(lengths: bytes, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a block's words, and the number of words of each document."""
    parts, at = [], 0
    while at < len(packed):
        cut = at + 8 + int.from_bytes(packed[at : at + 8], "little")
        parts.append(packed[at + 8 : cut])
        at = cut
    every, counts, rank = _keys_opened(parts[0]), _opened(parts[1]), _opened(parts[2])
    return every[_by_count(counts)][rank], np.frombuffer(lengths, "<u4").astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(hashes: np.ndarray, within: np.ndarray, order: int, bits: int = 64) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys, of so many bits, of the n-grams of 1 to ``order`` words in a row, and for each n the places where ``n`` words of a document end."""
    out, places, key = [], [], hashes
    for n in range(1, order + 1):
        if n > 1:
            key = np.concatenate([hashes[:1], key[:-1] * STEP + hashes[1:]])
        places.append(np.flatnonzero(within >= n - 1))
        out.append(mixed(key[places[-1]] + np.uint64(n)))
    return np.concatenate(out) >> np.uint64(64 - bits), places


def within_documents(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


ASK_DDL = "bucket long, block long, keys binary, counts binary"
ANSWER_DDL = "bucket long, block long, counts binary"


def _ask(order: int, buckets: int, bits: int):
    """A block's distinct n-grams and their counts, a row for each range of keys."""
    bars = np.array([(k << bits) // buckets for k in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, packed in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, size = _block(lengths, packed)
                keys, counts = np.unique(grams(hashes, within_documents(size), order, bits)[0], return_counts=True)
                cuts = [0, *np.searchsorted(keys, bars).tolist(), len(keys)]
                asked = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                for at in range(0, len(asked), 256):
                    some = asked[at : at + 256]
                    yield batch_of({"bucket": [k for k, _, _ in some], "block": [block] * len(some), "keys": [_keys_packed(keys[a:b]) for _, a, b in some], "counts": [_packed(counts[a:b]) for _, a, b in some]}, ASK_DDL)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, at = [], None

    def close():
        keys = [_keys_opened(r[2]) for r in held]
        every, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, of, np.concatenate([_opened(r[3]) for r in held]).astype(np.int64))
        ends = np.cumsum([0] + [len(k) for k in keys])
        for k in range(0, len(held), 64):
            some = held[k : k + 64]
            yield batch_of({"bucket": [r[0] for r in some], "block": [r[1] for r in some], "counts": [_packed(total[of[a:b]]) for a, b in zip(ends[k:], ends[k + 1 : k + 65])]}, ANSWER_DDL)

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if at is not None and at != r[0]:
                yield from close()
                held = []
            at = r[0]
            held.append(r)
    if held:
        yield from close()


SCORE_DDL = "doc_id long, n_words long, score double"


def _score(total: int, order: int, least: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, nulls, lengths, packed, answers in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, size = _block(lengths, packed)
                within = within_documents(size)
                keys, places = grams(hashes, within, order, bits)
                # buckets are ranges of keys, so their answers in a row are in order of the block's keys
                told = [_opened(a["counts"]) for a in sorted(answers or [], key=lambda a: a["bucket"])]
                counts = np.concatenate(told).astype(np.float64)[np.unique(keys, return_inverse=True)[1]] if told else np.zeros(0)
                ends = np.cumsum([0] + [len(p) for p in places])
                before = counts[: ends[1]]  # the count of the n-gram that ends here, one word shorter
                value = np.log(before / max(total, 1)) + within.clip(0, order - 1) * np.log(ALPHA)
                for n in range(2, order + 1):
                    at, here = places[n - 1], np.zeros(len(hashes))
                    here[at] = counts[ends[n - 1] : ends[n]]
                    known = at[here[at] >= least]
                    value[known] = np.log(here[known] / before[known - 1]) + (within[known].clip(0, order - 1) - (n - 1)) * np.log(ALPHA)
                    before = here
                sums = np.bincount(np.repeat(np.arange(len(size)), size), value, len(size))
                raw = np.frombuffer(doc_ids, "<i8").tolist()
                yield batch_of({"doc_id": [None if z else i for i, z in zip(raw, nulls)], "n_words": size.tolist(), "score": sums.tolist()}, SCORE_DDL)

    return run


def least_count(counts: DataFrame, n: int, most: int, ways: int = 64) -> int:
    """The largest count that at least ``n`` words have or exceed, 1 if there are fewer; ``most`` is no smaller than any count.

    Each pass over the counts cuts the range to a part in ``ways`` and brings as many numbers to the driver.
    """
    low, high = 1, most + 1  # the answer is in low..high - 1
    while high - low > 1:
        step = -(-(high - low) // ways)
        at = list(range(low + step, high, step))
        if not at:
            at = [low + 1]
        found = counts.agg(*[F.sum((F.col("n") >= t).cast("long")).alias(str(t)) for t in at]).first()
        reached = [t for t, c in zip(at, found) if (c or 0) >= n]
        low, high = (reached[-1], min(high, reached[-1] + step)) if reached else (low, at[0])
    return low


def scores(docs: DataFrame, order: int = 2, least: int = 2) -> DataFrame:
    """``doc_id, n_words, score`` of every row: the sum of its words' log scores."""
    if not 2 <= order <= 4:
        raise ValueError("order is 2 to 4")
    texts = id_text(docs)
    most = texts.agg(F.sum((F.length("text") + 1) / 2)).first()[0] or 0  # words that there can be
    blocks, _ = written(map_batches(texts, lambda batches, bits=bits_for(int(most), 1): _blocks(batches, bits), BLOCK_DDL), "blocks")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    buckets, bits = max(1, -(-total * order // BUCKET)), bits_for(total, order)
    asked = map_batches(blocks.select("block", "lengths", "words"), _ask(order, buckets, bits), ASK_DDL)
    dealt = asked.repartition("bucket").sortWithinPartitions("bucket", "block")
    told = map_batches(dealt, _answer, ANSWER_DDL)
    by_block = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    joined = blocks.join(by_block, "block", "left").select("doc_ids", "nulls", "lengths", "words", "answers")
    return map_batches(joined, _score(total, order, least, bits), SCORE_DDL)
