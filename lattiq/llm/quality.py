"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text gives a few statistics of its characters and words, as smoothed logarithms. Each class has a
Gaussian over them whose covariance is shrunk towards the covariance of both classes and towards a multiple
of the unit matrix. The score is the probability of label 1 from the difference of the two log densities; the
Cholesky factors of the covariances are computed once and sent with the scoring tasks.

Fitting takes sums and sums of products over at most train_rows labelled documents (those whose ids have the
smallest hashes), aggregated in Spark; the driver gets one row a class.

Defined cases: a null text is the empty text and gets a score; labels that are null are left out, labels that
repeat count as often; without rows of both classes every score is 0.5; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, only, prepare, staged

FOLDS, THRESHOLD = 5, 0.3
SHRINK_POOLED, SHRINK_UNIT = 0.10, 0.02
#: Labelled documents that are learned from at most.
TRAIN_ROWS = 20_000
NAMES = ("symbols", "upper", "digits", "marks", "letters", "repeats", "variety", "upper_words", "symbol_ends", "symbol_words")
#: Classes of characters: other symbols, lower-case letters, upper-case letters, digits, usual marks, space.
SYMBOL, LOWER, UPPER, DIGIT, MARK, SPACE = range(6)


@lru_cache(maxsize=100_000)
def _class(point: int) -> int:
    c = chr(point)
    return SPACE if c.isspace() else UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit() else MARK if c in ".,;:?'\"()-’“”" else SYMBOL


_CLASSES: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    """Class of each code point; a table holds the basic plane, those beyond are looked up one kind at a time."""
    if not _CLASSES:
        _CLASSES.append(np.fromiter(map(_class.__wrapped__, range(65536)), np.uint8, 65536))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = _CLASSES[0][np.minimum(points, 65535)]
    if (high := points > 65535).any():
        kinds, which = np.unique(points[high], return_inverse=True)
        out[high] = np.array([_class(int(k)) for k in kinds], np.uint8)[which]
    return out


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES. Smoothing leaves the empty text at usual values."""
    cls = classes(text)
    n = np.bincount(cls, minlength=6)
    chars = len(cls) - n[SPACE]
    words = text.split()
    w = len(words)
    after = np.append(cls[1:], SPACE) if len(cls) else cls
    before = np.append(SPACE, cls[:-1]) if len(cls) else cls
    ends = int(((cls == SYMBOL) & (after == SPACE)).sum())
    alone = int(((cls == SYMBOL) & (after == SPACE) & (before == SPACE)).sum())
    share = lambda x, of, usual, weight: float(np.log((x + usual * weight) / (of + weight)))
    return [
        share(n[SYMBOL], chars, 0.002, 40),
        share(n[UPPER], chars, 0.03, 40),
        share(n[DIGIT], chars, 0.004, 40),
        share(n[MARK], chars, 0.03, 40),
        share(n[LOWER] + n[UPPER], chars, 0.95, 40),
        share(sum(map(eq, words, words[1:])), w, 0.01, 8),
        share(len(set(words)), w**0.85, 1.0, 8),
        share(sum(x.isupper() and len(x) > 1 for x in words), w, 0.01, 8),
        share(ends - alone, w, 0.01, 8),
        share(alone, w, 0.01, 8),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row of docs."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in NAMES]])

    def run(b: pa.RecordBatch):
        rows = [statistics(x.as_py() or "") for x in b.column(1)]
        yield [b.column(0), *np.array(rows, np.float64).reshape(-1, len(NAMES)).T]

    return arrow_map(only(docs, doc_id="long", text="string"), run, schema)


@dataclass
class Model:
    """Means, inverse Cholesky factors and log terms of the two classes; None without rows of both."""

    means: np.ndarray | None
    factors: np.ndarray | None
    terms: np.ndarray | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), 0.5)
        logs = [t - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, t in zip(self.means, self.factors, self.terms)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo folds; -1 for a null id, which is in no held-out fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def labelled(labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, _y, _n (times) of the labels 0 and 1 outside the held-out fold: at most train_rows, those of the smallest hashes."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y")).where("doc_id is not null and _y in (0, 1)").where(fold("doc_id", FOLDS) != 0)
    return staged(rows.groupBy("doc_id", "_y").agg(F.count("*").alias("_n")).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(train_rows), "labelled")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the rows of stats that have a label 0 or 1 and are outside the held-out fold."""
    return _fitted(stats, labelled(labels, label, train_rows))


def _fitted(stats: DataFrame, known: DataFrame, pooled: float = SHRINK_POOLED, unit: float = SHRINK_UNIT) -> Model:
    rows = stats.join(F.broadcast(known), "doc_id")  # at most train_rows
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = rows.groupBy("_y").agg(F.sum("_n").alias("n"), *[F.sum(F.col(x) * F.col("_n")).alias(f"s{i}") for i, x in enumerate(NAMES)], *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j]) * F.col("_n")).alias(f"p{i}_{j}") for i, j in pairs])
    got = {r["_y"]: r for r in sums.collect()}  # a row a class
    if set(got) != {0, 1} or min(r["n"] for r in got.values()) < 2:
        return Model(None, None, None)
    means, covs, counts = [], [], []
    for y in (0, 1):
        r, n = got[y], got[y]["n"]
        mean = np.array([r[f"s{i}"] for i in range(d)]) / n
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / n - mean[i] * mean[j]
        means.append(mean)
        covs.append(cov)
        counts.append(n)
    both = np.average(covs, axis=0, weights=counts)
    factors, terms = [], []
    for cov, n in zip(covs, counts):
        s = (1 - pooled - unit) * cov + pooled * both + unit * max(np.trace(both) / d, 1e-6) * np.eye(d)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        terms.append(np.log(n / sum(counts)) - np.log(np.diag(low)).sum())
    return Model(np.array(means), np.array(factors), np.array(terms))


def scores(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of features()."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(b: pa.RecordBatch):
        yield [b.column(0), model.score(np.column_stack([b.column(k + 1).to_numpy() for k in range(len(NAMES))]))]

    scored = arrow_map(stats.select("doc_id", *NAMES), run, schema)
    return scored.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs, from a model fitted on labels."""
    stats = staged(features(docs), "statistics")
    return scores(stats, fit(stats, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted good, in its own columns."""
    prepare(docs.sparkSession)
    known = labelled(labels)
    texts = only(docs, doc_id="long", text="string")
    texts = texts.join(F.broadcast(known.select(F.col("doc_id").alias("_known")).distinct()), F.col("doc_id") == F.col("_known"), "left_semi")
    # statistics of the rows that are learned from; all rows are read again to be scored
    model = _fitted(staged(features(texts), "statistics"), known)

    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t or "") for t in texts], np.float64).reshape(-1, len(NAMES))
        return pd.Series(model.score(x))

    # only the text goes to Python and only scores come back; rows stay in the JVM
    return docs.where(F.pandas_udf(score, "double")("text") >= threshold)
