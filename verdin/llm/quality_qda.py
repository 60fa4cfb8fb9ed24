"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of a whole text (lengths, shares of character kinds, repetition, line shapes) are
transformed to be closer to normal.  Each class has a mean and a covariance from sums that Spark adds
up over all labelled rows; a covariance is shrunk towards the pooled one and towards its own
mean variance.  A score is the logistic of the difference of the two Gaussian log-densities, by
Mahalanobis distances through Cholesky factors that are made once, plus the log prior odds.

Null texts count as empty; empty texts have the statistics of no words.  Rows without a label, or with
one other than 0 and 1, teach nothing; with a class missing the score is the share of label 1 among the
labels (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdin.llm.common import ship_package, stored

NAMES = ("words", "word_length", "long_spread", "letters", "upper", "digits", "marks", "symbols", "distinct", "twin", "lines", "dup_lines",
         "bars", "shouts")
_KIND = np.zeros(256, np.uint8)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b" \t\n\r\x0b\x0c", 4), (b".,;:'\"()-", 5)):
    _KIND[list(_chars)] = _k
_KIND[128:] = 6


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7).astype(float)
    body = max(1.0, kinds.sum() - kinds[4])
    sizes = np.fromiter(map(len, words), np.int64, n)
    twins = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    # the root steadies small shares; the constant keeps a few characters of a short text from being large ones
    share = lambda x, total, add=20: float(np.sqrt(x / (total + add)))
    return [float(np.log1p(n)), float(np.log(sizes.mean())), float(np.log1p(sizes.std())), share(kinds[1] + kinds[2] + kinds[6], body, 0),
            share(kinds[1], body, 200), share(kinds[3], body, 200), share(kinds[5], body, 200), share(kinds[0], body, 200),
            # distinct words fall with length as a power of it; the exponent does not
            float(np.log(len(set(words)) + 1) / np.log(n + 1)), share(twins, n), float(np.log1p(len(lines)) / np.log1p(n)),
            share(len(lines) - len(set(lines)), len(lines)), share(raw.count(b"|"), n), share(raw.count(b"!"), n)]


def with_statistics(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and x (array of the statistics) of every row."""
    ship_package(docs.sparkSession)
    inner = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].alias("body"))
    schema = ", ".join([f"k{i} {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))] + ["x array<double>"])

    def run(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))],
                                             names=[*[f"k{i}" for i in range(len(keep))], "x"])

    return inner.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


class Qda:
    def __init__(self, counts, sums, products, pooled: float = 0.3, round_: float = 0.05):
        """counts (2,), sums (2, d), products (2, d, d) of the rows of label 0 and 1."""
        counts = np.asarray(counts, float)
        self.share = float(counts[1] / counts.sum()) if counts.sum() else 0.5
        self.fitted = bool((counts > 0).all())
        if not self.fitted:
            return
        mean = sums / counts[:, None]
        cov = [products[k] / counts[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
        together = (counts[0] * cov[0] + counts[1] * cov[1]) / counts.sum()
        self.mean, self.inverse, self.log_root = mean, [], []
        d = sums.shape[1]
        scale = np.sqrt(np.maximum(np.diag(together), 1e-6))   # shrinkage acts on standardised statistics
        self.scale = scale
        for k in (0, 1):
            # a class of few rows leans more on the pooled covariance
            w = max(pooled, d / (d + counts[k]))
            s = ((1 - w) * cov[k] + w * together) / np.outer(scale, scale)
            s = (1 - round_) * s + round_ * np.eye(d) * max(np.trace(s) / d, 1e-3)
            root = np.linalg.cholesky(s + 1e-6 * np.eye(d))
            self.inverse.append(np.linalg.inv(root))
            self.log_root.append(float(np.log(np.diag(root)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        log = [-0.5 * (((x - self.mean[k]) / self.scale @ self.inverse[k].T) ** 2).sum(axis=1) - self.log_root[k] for k in (0, 1)]
        odds = np.clip(log[1] - log[0] + np.log(self.share / (1 - self.share)), -500, 500)
        return 1 / (1 + np.exp(-odds))


def fit(statistics_: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", label: str = "quality", **options) -> Qda:
    """Moments of all labelled training rows: one pass, one row for each class to the driver."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    marks = labels.select(labels[doc_id].alias("l_id"), labels[label].cast("int").alias("y")).where("y IN (0, 1)")
    rows = statistics_.where(train).join(marks, statistics_[doc_id] == F.col("l_id"))
    got = rows.groupBy("y").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"),
                                F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p")).collect()
    counts, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in got:
        counts[r["y"]], sums[r["y"]] = r["n"], r["s"]
        for (i, j), v in zip(pairs, r["p"], strict=True):
            products[r["y"], i, j] = products[r["y"], j, i] = v
    return Qda(counts, sums, products, **options)


def classify(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.3, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` (doc_id among them), score and predicted of every row; ``train`` is a
    condition on ``keep`` for the rows whose labels teach."""
    table = stored(with_statistics(docs, keep, text), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(table, labels, train))   # two small matrices
    kept = list(keep)
    schema = ", ".join([f"`{c}` {table.schema[c].dataType.simpleString()}" for c in kept] + ["score double", "predicted int"])

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").flatten()).reshape(batch.num_rows, len(NAMES))
            s = model.value.scores(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=[*kept, "score", "predicted"])

    return table.mapInArrow(run, schema)
