"""Classification and ranking statistics from integer counts, divided at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.splits import running_by_range


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 for an empty denominator."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """``label, tp, fp, fn, precision, recall, f1`` from confusion counts, for each true class."""
    both = F.array(F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("truth") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col("truth") != F.col("predicted"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))
    sums = counts.select(F.explode(both).alias("x")).groupBy("x.label").agg(*[F.sum(f"x.{c}").cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return sums.where("tp + fn > 0").withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def by_score(rows: DataFrame, score: str, positive: str, weight: str | None = None) -> DataFrame:
    """``s, p, q, below_p, below_q``: positives and negatives of each distinct score, and of all lower scores, by range of scores."""
    w = F.lit(1) if weight is None else F.col(weight)
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(positive), w).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(w)).alias("q"))
    return running_by_range(by, "s", {"below_p": "p", "below_q": "q"})


def auroc_counts(rows: DataFrame, score: str, positive: str, weight: str | None = None) -> DataFrame:
    """``positives, negatives, wins2``: twice the wins of positives over negatives, ties half; rows count as often as ``weight``.

    Scores are grouped first; running totals over the groups are taken for each range of scores and then joined up.
    """
    run = by_score(rows, score, positive, weight)
    return run.agg(F.sum("p").cast("long").alias("positives"), F.sum("q").cast("long").alias("negatives"), F.sum(F.col("p") * (2 * F.col("below_q") + F.col("q"))).cast("long").alias("wins2"))


def average_precision(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """``ap``: precision at each distinct score, from the highest, weighed by the positives that it adds; null without positives."""
    run = by_score(rows, score, positive)
    total = run.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    x = run.crossJoin(F.broadcast(total))
    tp, fp = F.col("all_p") - F.col("below_p"), F.col("all_q") - F.col("below_q")
    return x.agg(F.sum(F.when(F.col("p") > 0, F.col("p") * tp / (tp + fp) / F.col("all_p"))).alias("ap"))


def fpr_at_tpr(rows: DataFrame, score: str, positive: str, target: float) -> DataFrame:
    """``fpr``: the share of negatives at or above the highest score at which the share of positives reaches the target; 1 if none does."""
    run = by_score(rows, score, positive)
    total = run.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    x = run.crossJoin(F.broadcast(total))
    tpr = (F.col("all_p") - F.col("below_p")) / F.greatest(F.lit(1), F.col("all_p"))
    fpr = (F.col("all_q") - F.col("below_q")) / F.greatest(F.lit(1), F.col("all_q"))
    return x.agg(F.coalesce(F.max_by(F.when(tpr >= target, fpr), F.when(tpr >= target, F.col("s"))), F.lit(1.0)).alias("fpr"))


def totals(per_label: DataFrame, counts: DataFrame) -> DataFrame:
    """One row from ``per_class`` and the confusion: accuracy, macro and micro figures; a predicted label that is no true one is invalid."""
    macro = per_label.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    n = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    bad = counts.join(per_label.select(F.col("label").alias("predicted")), "predicted", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("invalid"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = macro.crossJoin(n).crossJoin(bad).withColumns({"micro_precision": p, "micro_recall": r, "accuracy": ratio(F.col("right"), F.col("n"))})
    micro = F.when(F.col("micro_precision") + F.col("micro_recall") == 0, 0.0).otherwise(2 * F.col("micro_precision") * F.col("micro_recall") / (F.col("micro_precision") + F.col("micro_recall")))
    return out.select("n", "invalid", "accuracy", "macro_precision", "macro_recall", "macro_f1", "micro_precision", "micro_recall", micro.alias("micro_f1"))


def multilabel(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``family, tp, fp, fn`` of two sets of labels; a row ``""`` has the exact matches as ``tp`` and the others as ``fp``."""
    t, p = F.col(truth), F.col(predicted)
    part = lambda x, k: F.transform(x, lambda v: F.struct(v.alias("family"), F.lit(k).alias("kind")))
    same = F.array_sort(F.array_distinct(t)) == F.array_sort(F.array_distinct(p))
    exact = F.array(F.struct(F.lit("").alias("family"), F.when(same, "tp").otherwise("fp").alias("kind")))
    found = rows.select(F.explode(F.concat(part(F.array_intersect(t, p), "tp"), part(F.array_except(p, t), "fp"), part(F.array_except(t, p), "fn"), exact)).alias("x"))
    return found.groupBy("x.family").agg(*[F.count_if(F.col("x.kind") == k).alias(k) for k in ("tp", "fp", "fn")])


def calibration(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """``bin, n, correct, confidence`` of equal bins, left-closed, the last one closed; the error is ``sum |correct - confidence| / n``."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins)).cast("long")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.count_if(correct).alias("correct"), F.sum(confidence).alias("confidence"))


def risk_at_coverage(rows: DataFrame, confidence: str, wrong: str, key: str, at: list[float]) -> DataFrame:
    """``coverage, kept, wrong``: of the most confident share of rows (at least one), how many are wrong; ties by ``key``."""
    n = rows.agg(F.count("*").alias("n"))
    run = running_by_range(rows.select(confidence, key, F.lit(1).alias("one"), F.col(wrong).cast("int").alias("bad")), confidence, {"rank": "one"}, descending=True, tie=key)
    x = run.crossJoin(F.broadcast(n))
    kept = lambda c: F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(c).cast("decimal(6,3)")))
    cells = [F.struct(F.lit(c).alias("coverage"), F.sum(F.when(F.col("rank") < kept(c), 1).otherwise(0)).alias("kept"), F.sum(F.when(F.col("rank") < kept(c), F.col("bad")).otherwise(0)).alias("wrong")).alias(f"c{k}") for k, c in enumerate(at)]
    return x.agg(*cells).select(F.explode(F.array(*[f"c{k}" for k in range(len(at))])).alias("x")).select("x.*")


def weighted_ranks(rows: DataFrame, value: str, weight: str, out: str) -> DataFrame:
    """``rows`` with the mean rank of a value among rows that count as often as their weight; ties share a rank."""
    by = rows.groupBy(value).agg(F.sum(weight).alias("_w"))
    run = running_by_range(by, value, {"_before": "_w"}).select(value, (F.col("_before") + (F.col("_w") + 1) / 2).alias(out))
    return rows.join(run, value)


def weighted_pearson(x: str, y: str, w: str) -> Column:
    """An aggregate: the weighted correlation, null if either has no spread."""
    s = {n: F.sum(F.col(w) * e) for n, e in {"": F.lit(1.0), "x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "yy": F.col(y) * F.col(y), "xy": F.col(x) * F.col(y)}.items()}
    spread = (s["xx"] - s["x"] * s["x"] / s[""]) * (s["yy"] - s["y"] * s["y"] / s[""])
    return F.when(spread > 0, (s["xy"] - s["x"] * s["y"] / s[""]) / F.sqrt(spread))


def mutual_information(rows: DataFrame, x: str, y: str) -> DataFrame:
    """``information``: in nats, of two discrete columns, from their joint counts."""
    joint = rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    of = lambda c: joint.groupBy(c).agg(F.sum("n").alias(f"n_{c}"))
    total = joint.agg(F.sum("n").alias("t"))
    j = joint.join(of("x"), "x").join(of("y"), "y").crossJoin(F.broadcast(total))
    return j.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("n_x") * F.col("n_y")))).alias("information"))


def geometry(rows: DataFrame, label: str, vector: str) -> tuple[list, list, list]:
    """Labels, their mean vectors and the inverse of the shared covariance, shrunk towards a multiple of the identity.

    The sums of products, as many as the square of the dimension, are all that leaves the executors. The shrinkage is the
    one that minimises the expected squared error (Ledoit and Wolf): from the same sums and the sum of fourth powers of norms.
    """
    import numpy as np

    dim = rows.select(F.size(vector)).first()[0]
    v = rows.select(label, vector).where(F.size(vector) == dim)
    products = F.transform(F.sequence(F.lit(0), F.lit(dim * dim - 1)), lambda k: F.get(F.col(vector), F.floor(k / dim).cast("int")).cast("double") * F.get(F.col(vector), (k % dim).cast("int")).cast("double"))
    flat = v.select(label, vector, F.posexplode(products).alias("k", "x"))
    second = np.zeros(dim * dim)
    for r in flat.groupBy("k").agg(F.avg("x").alias("m")).collect():
        second[r["k"]] = r["m"]
    means, sizes = {}, {}
    for r in v.select(label, F.posexplode(vector).alias("k", "x")).groupBy(label, "k").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n")).collect():
        means.setdefault(r[label], np.zeros(dim))[r["k"]] = r["m"]
        sizes[r[label]] = r["n"]
    n = sum(sizes.values())
    centre = sum(means[y] * sizes[y] for y in means) / n
    cov = second.reshape(dim, dim) - np.outer(centre, centre)
    mid = F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(c)) for c in centre]), lambda a, c: (a.cast("double") - c) * (a.cast("double") - c)), F.lit(0.0), lambda a, x: a + x)
    fourth = v.agg(F.avg(mid * mid)).first()[0]
    mu = np.trace(cov) / dim
    delta = ((cov - mu * np.eye(dim)) ** 2).sum() / dim
    beta = min((fourth - (cov**2).sum()) / n / dim, delta)
    shrink = beta / delta if delta else 0.0
    labels = sorted(means)
    return labels, [means[y].tolist() for y in labels], np.linalg.pinv((1 - shrink) * cov + shrink * mu * np.eye(dim)).tolist()


def nearest_class(rows: DataFrame, key: str, vector: str, fitted: tuple[list, list, list]) -> DataFrame:
    """``key, label, distance, margin``: the class of least Mahalanobis distance, and how much farther the next one is."""
    import numpy as np
    import pandas as pd

    labels, means, inverse = fitted
    root = np.linalg.cholesky(np.array(inverse) + 1e-12 * np.eye(len(inverse)))  # distances are lengths after this map
    centres = np.array(means) @ root
    kinds = dict(rows.dtypes)

    def near(frames):
        for f in frames:
            if len(f):
                x = np.stack(f["_v"].to_numpy()).astype(float) @ root
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0))
                order = np.sort(d, axis=1)
                margin = order[:, 1] - order[:, 0] if d.shape[1] > 1 else np.full(len(d), np.nan)
                yield pd.DataFrame({key: f[key], "label": [str(labels[k]) for k in d.argmin(1)], "distance": order[:, 0], "margin": margin})

    return rows.where(F.size(vector) == len(inverse)).select(key, F.col(vector).alias("_v")).mapInPandas(near, f"{key} {kinds[key]}, label string, distance double, margin double")


def gates(row: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``gate, passed`` of each rule over one row of figures, and of all of them as ``ALL``."""
    cells = [F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rules.items()]
    every = F.lit(True)
    for c in rules.values():
        every = every & F.coalesce(c, F.lit(False))
    return row.select(F.explode(F.array(*cells, F.struct(F.lit("ALL").alias("gate"), every.alias("passed")))).alias("x")).select("x.*")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson score interval of ``k`` of ``n``; null for no trial."""
    p = k / n
    centre, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.greatest(F.lit(0.0), (centre - half) / scale), F.least(F.lit(1.0), (centre + half) / scale)
