"""Token ids of the word-BPE vocabulary, by the tokenizers library, with a bounded memo of pieces."""

from __future__ import annotations

import functools
import itertools
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

from tidewell.llm.bpe import MEMO

#: Fixed value: the pieces of the word-BPE vocabulary (its file's pre-tokenizer), for the characters of PLAIN.
LATIN_WORDS = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Characters on which Python's lower case and the library's normalizer surely agree, piece by piece.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u017f]*")


class WordTokens:
    """``ids_batch(texts)``: as the library's ``encode(text, add_special_tokens=False).ids``, as an array of uint32."""

    def __init__(self, path: str, most: int = MEMO):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        # the vocabulary's model alone, for pieces that are cut and lower-cased already
        self.words = Tokenizer(self.lib.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, vocab = self.lib.model.end_of_word_suffix, self.lib.get_vocab()
        self.ends_word = np.zeros(1 + max(vocab.values()), bool)
        self.ends_word[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.encode = getattr(self.words, "encode_batch_fast", self.words.encode_batch)
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text that can be encoded one by one, else None."""
        if "<|" in text or not (text.isascii() and text.isprintable() or PLAIN.fullmatch(text)):
            return None
        return LATIN_WORDS.findall(text.lower())

    def each(self, pieces: list[str]) -> Iterable[tuple[str, bytes]]:
        """Each piece and its ids. The pieces are encoded as one text of words; an id of a word's end closes a piece."""
        ids = array("I", self.encode([" ".join(pieces)], add_special_tokens=False)[0].ids)
        ends = (4 + 4 * np.flatnonzero(self.ends_word[ids])).tolist()
        if len(ends) == len(pieces) and ends[-1] == 4 * len(ids):
            raw = ids.tobytes()
            return zip(pieces, (raw[a:b] for a, b in zip([0, *ends], ends)))
        return zip(pieces, (array("I", e.ids).tobytes() for e in self.encode(pieces, add_special_tokens=False)))

    def ids_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the library encodes all pieces that the memo lacks in one call."""
        cut = [self.pieces(t) for t in texts]
        new = list({*itertools.chain.from_iterable(c for c in cut if c)}.difference(self.memo))
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = list({*itertools.chain.from_iterable(c for c in cut if c)})
        for at in range(0, len(new), 4096):
            self.memo.update(self.each(new[at : at + 4096]))
        of = self.memo.__getitem__
        return [np.frombuffer(self.whole(t) if c is None else b"".join(map(of, c)), "<u4") for t, c in zip(texts, cut)]


@functools.lru_cache(maxsize=2)
def of_file(path: str, most: int = MEMO) -> WordTokens:
    """One for a worker process: its memo, of at most so many pieces but for those of one batch, serves all of the worker's tasks."""
    return WordTokens(path, most)
