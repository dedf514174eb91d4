"""Operator 3: severity of toxicity by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigrid.llm.common import small_batches
from marigrid.llm.text import mix, shingles, word_batches

#: Labelled rows of each class that are fitted on, at most: the documented bound of the sample.
SAMPLE_PER_CLASS = 4000
#: Features, at most, and the documents of the sample that each must be in.
FEATURES, LEAST_DOCS = 2000, 5
#: Chi-square of a feature with one degree of freedom, at least (p < 1e-6).
LEAST_CHI2 = 24.0
#: Times as often in one class as in the other, at least.
LEAST_LIFT = 5.0
GRADES = 4
REJECT = 0.5
_LOWER = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and white space part them."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(_LOWER).split()


@dataclass(frozen=True)
class Model:
    """P(grade <= k) = sigmoid(cuts[k] - score); the weights are shared by all cuts."""

    weights: dict[bytes, float]
    cuts: tuple[float, ...]

    def score(self, found: list[bytes]) -> float:
        hits = Counter(w for w in found if w in self.weights)
        return sum(self.weights[w] * (1.0 + np.log(n)) for w, n in sorted(hits.items()))

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score."""
        below = 1 / (1 + np.exp(-np.clip(np.asarray(self.cuts)[None, :] - score[:, None], -40, 40)))
        edge = np.ones((len(score), 1))
        return np.diff(np.concatenate([0 * edge, below, edge], 1), axis=1)


def fit_cuts(x: np.ndarray, y: np.ndarray, grades: int, l2: float = 1e-6, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts of the cumulative-link model with least penalised log loss (Adam)."""
    n, d = x.shape
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / max(n, 1), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    # the first cut and the logs of the steps between cuts
    p = np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    upper, lower = np.minimum(y, grades - 2), np.maximum(y - 1, 0)
    has_upper, has_lower = y < grades - 1, y > 0
    for t in range(1, steps + 1):
        w, cuts = p[:d], p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))])
        s = x @ w
        a = np.where(has_upper, 1 / (1 + np.exp(-np.clip(cuts[upper] - s, -40, 40))), 1.0)
        b = np.where(has_lower, 1 / (1 + np.exp(-np.clip(cuts[lower] - s, -40, 40))), 0.0)
        q = np.maximum(a - b, 1e-12)
        ga, gb = -a * (1 - a) / q / n, b * (1 - b) / q / n
        gc = np.bincount(upper[has_upper], ga[has_upper], grades - 1) + np.bincount(lower[has_lower], gb[has_lower], grades - 1)
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([-(x.T @ (ga * has_upper + gb * has_lower)) + l2 * w, [gc.sum()], tail[1:] * np.exp(p[d + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:d], p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))])


def _distinct(texts: list[str | None]) -> list[int]:
    """Places of texts that share none of three min-hashes of their five-word runs (or their words) with an earlier one."""
    seen: set = set()
    keep = []
    for base, found, rows in word_batches(pa.array(texts, pa.string()), bare=True):
        h, at = shingles(found, rows, 5)
        cuts = np.searchsorted(at, rows)
        for r in range(len(rows) - 1):
            own = h[cuts[r] : cuts[r + 1]] if cuts[r + 1] > cuts[r] else found[rows[r] : rows[r + 1]]
            marks = {(j, int(mix(own ^ np.uint64(j * 0x9E3779B97F4A7C15 & (2**64 - 1))).min())) for j in range(3)} if len(own) else {None}
            if seen.isdisjoint(marks):
                keep.append(base + r)
            seen |= marks
    return keep


def fit_texts(texts: list[str | None], toxic: list[int]) -> Model:
    """A model from labelled texts. Copies and near copies count once, as their words would all look telling.

    Labels are binary, so the grades are: 0 not toxic; toxic texts by thirds of how often they use the words
    that tell the classes apart, 1 (mild) to 3 (severe). Without both classes nothing is toxic.
    """
    own = _distinct(texts)
    label = np.array([toxic[i] for i in own], int)
    if not len(label) or label.min() == label.max():
        return Model({}, (20.0, 21.0, 22.0))
    # texts as arrays of word numbers and counts: small beside the words themselves
    number: dict[bytes, int] = {}
    docs = [np.unique(np.array([number.setdefault(w, len(number)) for w in words(texts[i])], np.int64), return_counts=True) for i in own]
    name = list(number)
    has = [np.bincount(np.concatenate([d for (d, _), y in zip(docs, label, strict=True) if y == c]), minlength=len(name)) for c in (0, 1)]
    n0, n1 = int((label == 0).sum()), int((label == 1).sum())
    a, b = has[1], has[0]
    c, d, n = n1 - a, n0 - b, n0 + n1
    chi2 = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n1 * n0, 1)
    lift = np.abs(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)))
    fit_for_use = np.flatnonzero((a + b >= LEAST_DOCS) & (chi2 >= LEAST_CHI2) & (lift >= np.log(LEAST_LIFT)))
    chosen = np.array(sorted(fit_for_use.tolist(), key=lambda i: (-chi2[i], name[i]))[:FEATURES], np.int64)
    vocabulary = [name[i] for i in chosen]
    slot = np.full(len(name), -1)
    slot[chosen] = np.arange(len(chosen))
    x = np.zeros((len(docs), len(chosen)))
    telling = a[chosen] * n0 > b[chosen] * n1
    used = np.zeros(len(docs))
    for r, (found, times) in enumerate(docs):
        at, times = slot[found], times[slot[found] >= 0]
        at = at[at >= 0]
        x[r, at] = 1 + np.log(times)
        used[r] = (times * telling[at]).sum()
    thirds = np.quantile(used[label == 1], [1 / 3, 2 / 3])
    y = np.where(label == 1, 1 + (used > thirds[0]) + (used > thirds[1]), 0)
    w, cuts = fit_cuts(x, y, GRADES)
    return Model(dict(zip(vocabulary, map(float, w), strict=True)), tuple(map(float, cuts)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from at most ``per_class`` labelled rows of each class: those whose hashed id comes first.

    Null labels and ids take no part. Of rows with one id and label the least text counts, once, so that no more than the
    sample reaches the driver. The sample's ids, bounded by ``per_class``, are broadcast.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).dropna()
    first = [known.filter(F.col("__toxic") == c).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(first[0].unionByName(first[1]))
    rows = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).join(sample, "__id")
    rows = rows.groupBy("__id", "__toxic").agg(F.min("__text").alias("__text")).select("__id", "__text", "__toxic").collect()
    rows.sort(key=lambda r: (r[0], r[1] or "", r[2]))
    return fit_texts([r[1] for r in rows], [r[2] for r in rows])


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, is_toxic) of every row's whole text.

    ``severity`` is the expected grade (0 to 3), ``grade`` the likeliest, ``p_toxic`` the chance of a grade over 0;
    ``is_toxic`` holds from ``p_toxic`` 0.5 on. Null and empty texts have no features and so the base rate. One
    row out for each row in, repeated ones too; there is no shuffle.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "severity", "grade", "p_toxic", "is_toxic"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.score(words(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()], float)
            p = model.grades(score)
            toxic = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= REJECT)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, severity double, grade int, p_toxic double, is_toxic boolean")


def rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without toxic rows; columns stay as they are, whatever their names.

    Each row is judged by its whole text, repeated ones alike; rows with null text stay, and those with an empty one if
    the base rate is under one half. An empty table stays empty. There is no shuffle.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def clean(texts):
        score = np.array([model.score(words(t)) for t in texts], float)
        return texts.isna() | (1 - model.grades(score)[:, 0] < REJECT)

    return docs.filter(clean(F.col(text_col)))
