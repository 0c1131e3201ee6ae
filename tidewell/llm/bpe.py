"""Byte-level BPE: encoding by a priority queue of merge ranks over a linked symbol list, decoding by concatenation.

Nulls count as empty texts; an empty text has no ids and decodes to the empty text. Rows are independent of each
other: repeated rows and ids give repeated results, and columns other than the id and the text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewell.llm.common import arrow_schema, id_text, map_batches

#: Fixed value: the pattern by which byte-level BPE vocabularies of this family cut a text into pieces.
PIECES = regex.compile(r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same for texts of characters below U+0250 alone, whose letters, digits and spaces are named: the plain engine is faster.
LATIN = re.compile("[\x00-ɏ]*")
LATIN_PIECES = re.compile(
    " ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    "| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ0-9\xb2\xb3\xb9\xbc-\xbe]+"
    "|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
#: Entries of a worker's memo of encoded pieces, and the longest piece that it keeps: a bound on memory, not on work.
MEMO, MEMO_CHARS = 600_000, 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


def pieces(text: str) -> list[str]:
    return (LATIN_PIECES if text.isascii() or LATIN.fullmatch(text) else PIECES).findall(text)


class Memo(dict):
    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, piece: str) -> bytes:
        ids = self.of(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """Vocabulary, merges and special tokens of a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.of_byte = [vocab[s] for s in symbols]
        back = {s: b for b, s in enumerate(symbols)}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = {k: np.uint32(v).tobytes() for k, v in special.items()}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.memo = Memo(self.piece)

    def piece(self, text: str) -> bytes:
        """The ids of one piece as little-endian unsigned 32-bit integers.

        The queue holds ``rank << 32 | place`` of the left symbol; an entry is stale, and skipped, if the pair that
        now begins at its place has another rank.
        """
        ids, rank = [self.of_byte[b] for b in text.encode()], self.rank
        n = len(ids)
        if n > 1:
            after = list(range(1, n + 1))
            before = list(range(-1, n))
            queue = [r << 32 | at for at, pair in enumerate(zip(ids, ids[1:])) if (r := rank.get(pair)) is not None]
            heapq.heapify(queue)
            while queue:
                top = heapq.heappop(queue)
                at = top & 0xFFFFFFFF
                right = after[at]
                if right >= n or rank.get((ids[at], ids[right])) != top >> 32:
                    continue
                ids[at], ids[right] = new, _ = self.merged[top >> 32], -1
                after[at] = last = after[right]
                before[last] = at
                if last < n and (r := rank.get((new, ids[last]))) is not None:
                    heapq.heappush(queue, r << 32 | at)
                if (first := before[at]) >= 0 and (r := rank.get((ids[first], new))) is not None:
                    heapq.heappush(queue, r << 32 | first)
            ids = [i for i in ids if i >= 0]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.cut and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return b"".join(self.special[p] if k % 2 else b"".join(map(self.memo.__getitem__, pieces(p))) for k, p in enumerate(parts))
        return b"".join(map(self.memo.__getitem__, pieces(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def of_file(path: str) -> ByteBpe:
    """One for a worker process: its memo serves all of the worker's tasks."""
    return ByteBpe(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids (binary), decoded (string)`` of every whole text."""
    ddl = "doc_id long, n_tokens long, ids binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = of_file(path), arrow_schema(ddl)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], schema=schema)

    return map_batches(id_text(docs), run, ddl)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_decode``, with the SHA-256 of ids and of decoded text instead of both: they stay in the worker."""
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = of_file(path), arrow_schema(ddl)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            sums = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sums), pa.array(back)], schema=schema)

    return map_batches(id_text(docs), run, ddl)
