"""Language identification with string kernels.

The kernel is the blended-spectrum presence kernel: the number of character n-grams, of 1 to 3 characters, that two
texts have in common, over the geometric mean of how many each has. Texts are lower-cased, and all that is not a
letter counts as one space. n-grams are hashed to ``TABLE`` places. Nystroem landmarks make the kernel a feature map
``k(x, landmarks) @ K^(-1/2)``, on which one-versus-rest kernel ridge regression is solved in closed form. Since the
kernel is an inner product of presence vectors, landmarks, whitening and ridge weights fold into one matrix with a
column for each language; a batch of texts is scored by the product of its presence matrix and that matrix.

The fit reads a bounded sample (``per_language`` texts of each language, the least hashes of id and text); prediction
reads every whole text and nothing but the text. A null text, or one without a letter, is ``und`` with score 0. Ties
between languages go to the first in sorted order. Without labelled rows every text is ``und``. Repeated rows and ids
are predicted each for itself; columns beyond the named ones are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_batches

UNKNOWN = "und"
TABLE = 1 << 16
#: The bounds of the fit: texts and landmarks of each language, and languages.
PER_LANGUAGE, LANDMARKS, LANGUAGES = 400, 48, 500
RIDGE = 1e-2
#: Share of held-out labelled texts that may be less like the learned languages than twice the bar of ``least_near``.
UNLIKE = 0.001
#: Texts scored in one product.
ROWS = 64


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


def places(text: str) -> np.ndarray | None:
    """Where the n-grams of a text lie, with repeats; None without a letter."""
    raw = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")] if text else np.zeros(0, np.uint32)
    is_letter = raw != 32
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # a run of others counts as one space
    x = np.concatenate([[32], raw[keep], [32]]).astype(np.uint32)
    one = x * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + x[1:] * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + x[2:] * np.uint32(0x165667B1)
    return np.concatenate([h >> np.uint32(16) for h in (one, two, three)])


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The presence matrix of some texts, and which have a letter."""
    out, some = np.zeros((len(texts), TABLE), np.float32), np.zeros(len(texts), bool)
    for k, t in enumerate(texts):
        if t and (at := places(t)) is not None:
            out[k, at] = 1
            some[k] = True
    return out, some


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # a row for each place of the table, a column for each language, and one more for each: its landmarks' mean

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores, and how near a text is to the nearest language: the mean kernel with its landmarks."""
        langs, scores, near = [], [], []
        n = len(self.languages)
        for at in range(0, len(texts), ROWS):
            x, some = presence(texts[at : at + ROWS])
            y = x @ self.weights / np.sqrt(np.maximum(x.sum(1), 1))[:, None] if self.languages else np.zeros((len(x), 1))
            best = y[:, : max(1, n)].argmax(1)
            near += (y[:, n:].max(1) * some).tolist() if n else [0.0] * len(x)
            for k in range(len(x)):
                known = bool(some[k]) and bool(self.languages)
                langs.append(self.languages[best[k]] if known else UNKNOWN)
                scores.append(float(np.clip((1 + y[k, best[k]]) / 2, 0, 1)) if known else 0.0)
        return langs, scores, near


def fit_rows(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model of some labelled texts: the first ``landmarks`` of each language are the landmarks."""
    found = [at for t in texts if (at := places(t)) is not None]
    kept = [(np.unique(at), lang) for at, lang in zip(found, [y for t, y in zip(texts, langs) if places(t) is not None])]
    names = sorted({y for _, y in kept})
    if not names:
        return Model([], np.zeros((TABLE, 1), np.float32))
    own_marks = {name: [x for x, y in kept if y == name][:landmarks] for name in names}
    marks = [at for name in names for at in own_marks[name]]
    z = np.zeros((TABLE, len(marks)), np.float32)
    for k, at in enumerate(marks):
        z[at, k] = 1 / np.sqrt(len(at))
    to_marks = lambda at: z[at].sum(0) / np.sqrt(len(at))
    own = np.array([to_marks(at) for at in marks], np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max())) @ vectors.T
    x = np.array([to_marks(at) for at, _ in kept]) @ whiten
    y = np.where(np.array([k for _, k in kept])[:, None] == np.array(names)[None], 1.0, -1.0)
    beta = np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(len(marks)), x.T @ y)
    of = np.repeat(np.arange(len(names)), [len(own_marks[name]) for name in names])
    means = np.stack([z[:, of == k].mean(1) for k in range(len(names))], axis=1)
    return Model(names, np.concatenate([(z.astype(np.float64) @ (whiten @ beta)).astype(np.float32), means], axis=1))


def least_near(texts: list[str], langs: list[str], folds: int = 5) -> float:
    """A bar for nearness, from labelled texts in random order: half of what all but ``UNLIKE`` of them reach when held out.

    Texts of a script that was not learned share hardly more than spaces with any landmark and lie far below it.
    """
    found: list[float] = []
    for k in range(folds):
        rest = [i for i in range(len(texts)) if i % folds != k]
        model = fit_rows([texts[i] for i in rest], [langs[i] for i in rest])
        found += model.predict([t for t in texts[k::folds] if places(t) is not None])[2]
    return float(np.quantile(found, UNLIKE)) / 2 if found else 0.0


def sample_rows(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and languages of a bounded sample of ``doc_id, text, lang`` rows, chosen and ordered by hash.

    The sample takes, of each of the ``LANGUAGES`` most frequent languages, the rows whose hash is below a bar set by
    the language's count, so no task ever holds a language's rows. Very long texts are whole in the sample as well.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)).alias("rank"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    bar: Column | None = None
    for r in counts:
        some = (F.col("lang") == r["lang"]) & (F.col("rank") <= int(min(1.0, per_language / r["count"]) * (1 << 31)))
        bar = some if bar is None else bar | some
    if bar is None:
        return [], []
    sample = rows.where(bar).orderBy("rank", "lang").limit(2 * per_language * len(counts)).collect()
    sample.sort(key=lambda r: (r["rank"], r["lang"], r["text"]))
    return [r["text"] for r in sample], [r["lang"] for r in sample]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Fit on ``doc_id, text, lang`` rows; a bounded sample of them goes to the driver."""
    return fit_rows(*sample_rows(labelled, per_language), landmarks)


def predict(docs: DataFrame, model: Model, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the prediction for ``text``, its score and, if a third name is given, its nearness, in further columns."""
    cols = docs.columns
    inner = docs.select(F.struct(*[docs[c].cast("string").alias(c) if c == "text" else docs[c] for c in cols]).alias("row"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in inner.schema["row"].dataType.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            langs, *figures = held.value.predict(rows.field(cols.index("text")).to_pylist())
            told = [pa.array(langs, pa.string()), *[pa.array(f, pa.float64()) for f in figures]][: len(names)]
            yield pa.RecordBatch.from_arrays([rows, *told], names=["row", *names])

    kinds = ", ".join(f"`{n}` {k}" for n, k in zip(names, ("string", "double", "double")))
    out = map_batches(inner, run, f"row struct<{fields}>, {kinds}")
    return out.select(*[F.col(f"row.`{c}`") for c in cols], *names)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, learned from the rows that are not held out."""
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", F.coalesce(rest == 1, F.lit(False)).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model).drop("text")
