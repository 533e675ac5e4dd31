"""Quality classifier: regularised quadratic discriminant analysis over statistics of a document's text.

A pass over the texts gives each document a vector of transformed statistics, which is written once. The labelled rows'
vectors are summed to counts, sums and products per class on the executors; only these few hundred numbers reach the driver.
Each class's covariance is shrunk towards the pooled one and its diagonal, and factored once (Cholesky); a document's score is
the logistic function of the difference of the classes' log densities, from Mahalanobis distances by the cached factors,
plus the log of the classes' ratio.

Defined results: a null text is empty and gets a score like any other; repeated rows each get a score; of conflicting labels of
a document the majority counts, a tie counts as good; labels of null documents or null quality are ignored; without labelled
rows of both classes, the score is the share of good rows (0.5 without any); texts of any length are measured whole; other columns
are carried along, but those called stats or score give way to the ones that are added; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, spread, table

#: Score from which a document is kept.
THRESHOLD = 0.7
#: Share of the pooled covariance in each class's, then share of the diagonal.
POOLED, DIAGONAL = 0.5, 0.3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_STOP = b".,;:?'\"()-"
_SYMBOL = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGIT + _STOP)
_NAMES = ("chars", "words", "length", "long", "distinct", "upper", "digit", "stop", "symbol", "symbol_words", "lines", "line_repeats", "top", "other", "bangs", "short")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics, in the order of _NAMES; all finite, also for an empty text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = max(len(raw), 1)
    words = text.split()
    k = max(len(words), 1)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    upper, digit, stop, symbol = share(_UPPER), share(_DIGIT), share(_STOP), share(_SYMBOL)
    lower = share(_LOWER)
    lines = [x for x in text.split("\n") if x]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    marked = sum(w[-1] in "#$%&*!|~^<>{}[]_=+\\" for w in words)
    shouted = text.count("!")
    logit = lambda p: float(np.log((p + 0.002) / (1.002 - min(p, 1.0))))
    lengths = len(text) - len(words) + 1
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(np.log1p(lengths / k)),
        float(np.log1p(max(map(len, words), default=0))),
        logit(len(counts) / k),
        logit(upper / max(upper + lower, 1e-9) if upper + lower else 0.0),
        logit(digit),
        logit(stop),
        logit(symbol),
        logit(marked / k),
        float(np.log1p(len(lines) * 100 / k)),
        logit(1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0),
        logit(max(counts.values(), default=0) / k),
        logit(1 - (len(raw.decode("utf-8").encode("ascii", "ignore")) / n) if raw else 0.0),
        logit(shouted / n),
        float(len(words) < 8),
    ]


@dataclass(frozen=True)
class Discriminant:
    """A fitted classifier: the classes' means and Cholesky factors of their precisions, or a constant score."""

    constant: float
    means: np.ndarray | None = None
    roots: np.ndarray | None = None  # inverse of the lower Cholesky factor, for each class
    logs: np.ndarray | None = None  # log of the class's share less half the log determinant

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        density = [c - 0.5 * np.square((x - m) @ r.T).sum(axis=1) for m, r, c in zip(self.means, self.roots, self.logs)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -50, 50)))


def from_moments(n: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """n (2,), sums (2, d) and products (2, d, d) of the classes 0 and 1."""
    if n.min() < 2:
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5)
    means = sums / n[:, None]
    scatter = products - n[:, None, None] * np.einsum("ki,kj->kij", means, means)
    common = scatter.sum(axis=0) / n.sum()
    common += np.eye(len(common)) * (1e-6 + 1e-3 * np.trace(common) / len(common))
    roots, logs = [], []
    for k in (0, 1):
        own = (1 - pooled) * scatter[k] / n[k] + pooled * common
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(common))
        factor = np.linalg.cholesky(own)
        roots.append(np.linalg.inv(factor))
        logs.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(0.5, means, np.array(roots), np.array(logs))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with an array column stats. Every other column is carried along."""
    docs = docs.drop("stats")
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def measure(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            yield (*row, statistics(row[at]))

    return map_rows(docs, f"{schema}, stats array<double>", measure)


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """measured(id, stats), labels(id, quality). All labelled rows are used; sums of both meet before they are shuffled."""
    clear = labels.filter("id is not null and quality is not null").groupBy("id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    rows = measured.select("id", "stats").join(clear, "id").select("quality", "stats")
    d = len(_NAMES)

    def moments(batches: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros((2, 1 + d + d * d))
        some = list(batches)
        for k in (0, 1):
            if own := [s for q, s in some if q == k]:
                x = np.array(own)
                total[k] = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                yield k, total[k].tolist()

    parts = map_rows(rows, "quality int, moments array<double>", moments)
    summed = parts.select("quality", F.posexplode("moments").alias("at", "v")).groupBy("quality", "at").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in summed.collect():  # two classes times the number of moments
        total[r.quality, r["at"]] = r.v
    return from_moments(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def scored(measured: DataFrame, model: Discriminant) -> DataFrame:
    """measured with its stats replaced by score."""
    measured = measured.drop("score")
    kept = [f for f in measured.schema.fields if f.name != "stats"]
    at = measured.columns.index("stats")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def apply(rows: Iterator[tuple]) -> Iterator[tuple]:
        some = list(rows)
        if some:
            for row, s in zip(some, model.scores(np.array([r[at] for r in some], float)).tolist()):
                yield (*row[:at], *row[at + 1 :], s)

    return map_rows(measured, f"{schema}, score double", apply)


def held_out(id_col: str = "doc_id"):
    """Column: the row belongs to the quarter whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out()).select(F.col("doc_id").alias("id"), "quality")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    measured = materialize(with_statistics(docs).select(F.col("doc_id").alias("id"), "stats"), "quality-stats")
    model = fit(measured, learnable(table(spark, sf_dir, "labels")))
    return scored(measured, model).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier, fitted on the labels of docs, doesn't reject."""
    # The two columns that are added get names of their own, whatever other columns docs has.
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    measured = materialize(with_statistics(plain, names["text"]), "quality-docs")
    model = fit(measured.select(F.col(names["doc_id"]).alias("id"), "stats"), learnable(labels))
    return scored(measured, model).filter(F.col("score") >= threshold).select(*(F.col(n).alias(c) for c, n in names.items()))
