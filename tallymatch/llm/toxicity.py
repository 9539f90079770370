"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w x - threshold_k): one weight vector for all ordered thresholds. x marks the distinct lower-cased words
of a text and their first four letters. Labels say toxic or not; the severity of toxic documents is graded by how many features
they hold that tell toxic from clean documents: grade 1 up to the median, grade 2 beyond it. The model is fitted on a bounded
sample of labelled documents (the first SAMPLE by a hash of their id) under an L1 penalty, so that only telling features keep a
weight and a long text gathers none from the rest, and once more without its shrinkage. Scoring looks at the whole of every
text. The expected severity is the sum of P(grade >= k) over the thresholds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, table, thrifty
from .shingles import parts

#: Labelled documents to fit on, at most.
SAMPLE = 6_000
GRADES = 3
_NEVER = 700.0
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[int]:
    words = set(_WORD.findall((text or "").lower()))
    stems = {w[:4] for w in words if len(w) >= 4}
    digest = xxhash.xxh3_64_intdigest
    return {digest(w) >> 1 for w in words} | {digest("^" + s) >> 1 for s in stems}


class Model(NamedTuple):
    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def severity(self, text: str | None) -> tuple[float, list[float]]:
        """Expected severity and P(grade >= k) for each k."""
        get = self.weights.get
        score = sum(w for f in features(text) if (w := get(f)) is not None)
        at_least = [1 / (1 + np.exp(min(500.0, t - score))) for t in self.thresholds]
        return float(sum(at_least)), at_least


def telling(n, bad, rate, names: int):
    """Whether a feature of n documents, bad of them toxic, tells the kinds apart: by its likelihood ratio (numpy or Columns).

    The bound is what the most uneven of so many names would reach by chance.
    """
    if isinstance(n, np.ndarray):
        part = lambda k, of: k * np.log(np.maximum(k, 1e-12) / np.maximum(of, 1e-12))
    else:
        part = lambda k, of: k * F.log(F.greatest(k, F.lit(1e-12)) / F.greatest(of, F.lit(1e-12)))
    return 2 * (part(bad, n * rate) + part(n - bad, n * (1 - rate))) > 2 * math.log(max(names, 1))


def fit(rows: list[tuple[np.ndarray, int]], l1: float = 1e-4, steps: int = 300) -> Model:
    """rows: sorted feature hashes, and 1 if toxic. Equal documents count once. Only telling features are fitted."""
    rows = list({(f.tobytes(), g): (f, g) for f, g in rows}.values())
    y = np.array([g for _, g in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return fit_telling([], np.empty(0, np.int64), l1, steps)
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    names, which = np.unique(np.concatenate([f for f, _ in rows]), return_inverse=True)
    n, bad = np.bincount(which, minlength=len(names)), np.bincount(which, weights=y[doc] > 0, minlength=len(names))
    keep = telling(n, bad, (y > 0).mean(), len(names))
    return fit_telling([(f[np.isin(f, names[keep])], g) for f, g in rows], names[keep], l1, steps)


def fit_telling(rows: list[tuple[np.ndarray, int]], names: np.ndarray, l1: float = 1e-4, steps: int = 300) -> Model:
    """rows: the telling features of each document, and 1 if toxic; names: these features, sorted. Without both kinds, or names, nothing is toxic.

    First with the L1 penalty, which selects, then the selected ones without its shrinkage.
    """
    y = np.array([g for _, g in rows], np.int64)
    if len(set(y.tolist())) < 2 or not len(names):
        return Model({}, (_NEVER,) * (GRADES - 1))
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0].tobytes(), rows[k][1]))  # sums must not depend on the order of rows
    rows, y = [rows[k] for k in order], y[order]
    m, rate = len(rows), (y > 0).mean()
    doc = np.repeat(np.arange(m), [len(f) for f, _ in rows])
    col = np.searchsorted(names, np.concatenate([f for f, _ in rows]).astype(names.dtype))
    n, bad = np.bincount(col, minlength=len(names)), np.bincount(col, weights=y[doc] > 0, minlength=len(names))
    dose = np.bincount(doc, weights=(bad > n * rate)[col], minlength=m)
    y = y + ((y > 0) & (dose > np.median(dose[y > 0])))
    theta = np.log((1 - rate) / rate) + 2.0 * np.arange(y.max())  # a grade that does not occur has no threshold
    x = _l1_path(doc, col, np.r_[np.zeros(len(names)), theta], y, l1, steps)
    w, theta = x[: len(names)], x[len(names) :]
    on = w[col] != 0
    held, again = np.unique(col[on], return_inverse=True)
    x = _lbfgs(lambda x: _loss(doc[on], again, x, y, 1e-6), np.r_[w[held], theta], 200)
    return Model(dict(zip(names[held].tolist(), x[: len(held)].tolist(), strict=True)), (*np.sort(x[len(held) :]).tolist(), _NEVER, _NEVER)[: GRADES - 1])


def _loss(doc: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the grades and its gradient; x holds the weights, then the thresholds."""
    m, at = len(y), np.arange(len(y))
    cuts = int(y.max())
    w, theta = x[:-cuts], np.sort(x[-cuts:])
    # p[:, g] = P(grade >= g); a grade's own probability is a difference of two
    score = np.bincount(doc, weights=w[col], minlength=m)
    p = 1 / (1 + np.exp(np.clip(np.r_[-np.inf, theta, np.inf][None, :] - score[:, None], -500, 500)))
    p[:, 0], p[:, -1] = 1, 0
    own, slope = np.maximum(p[at, y] - p[at, y + 1], 1e-12), p * (1 - p)
    gw = np.bincount(col, weights=((slope[at, y + 1] - slope[at, y]) / own / m)[doc], minlength=len(w)) + l2 * w
    gt = np.array([((slope[:, k] / own)[y == k].sum() - (slope[:, k] / own)[y == k - 1].sum()) / m for k in range(1, cuts + 1)])
    return float(-np.log(own).mean() + l2 / 2 * (w @ w)), np.r_[gw, gt]


def _lbfgs(loss, x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = g.copy(), []
        for s, v, r in reversed(past):
            alphas.append(r * (s @ d))
            d -= alphas[-1] * v
        if past:
            s, v, _ = past[-1]
            d *= (s @ v) / (v @ v)
        for (s, v, r), alpha in zip(past, reversed(alphas), strict=True):
            d += (alpha - r * (v @ d)) * s
        slope, t = g @ d, 1.0
        while t > 1e-10 and not (after := loss(x - t * d))[0] <= f - 1e-4 * t * slope:
            t /= 2
        if t <= 1e-10 or slope < 1e-14:
            break
        s, v = -t * d, after[1] - g
        if s @ v > 1e-14:
            past = [*past[1 - memory :], (s, v, 1 / (s @ v))]
        x, (f, g) = x - t * d, after
    return x


def _l1_path(doc: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, l1: float, steps: int) -> np.ndarray:
    """Accelerated proximal gradient steps under an L1 penalty on the weights."""
    cuts = int(y.max())
    n = len(x) - cuts
    long = np.ones(n)
    for _ in range(15):  # the largest curvature, by power iteration
        long /= max(np.linalg.norm(long), 1e-12)
        long = np.bincount(col, weights=np.bincount(doc, weights=long[col], minlength=len(y))[doc], minlength=n)
    step = np.r_[np.full(n, 1 / max(0.5 * np.linalg.norm(long) / len(y), 1e-4)), np.full(cuts, 2.0)]
    shrink = step * np.r_[np.full(n, l1), np.zeros(cuts)]
    ahead, pace = x, 1.0
    for _ in range(steps):
        new = ahead - step * _loss(doc, col, ahead, y, 0.0)[1]
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        if ((ahead - new) * (new - x) / step).sum() > 0:  # overshot: start the acceleration again
            faster = 1.0
        ahead, x, pace = new + (pace - 1) / faster * (new - x), new, faster
    return x


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for whole in batches for x in parts(whole, 0)):
        found = [sorted(features(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), batch.column(1)], names=["features", "bad"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most sample labelled documents; labels with a null, and of ids that documents lack, count for nothing.

    Features are counted where they are; the driver gets the telling ones, and of each document those alone.
    """
    picked = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("__id"), (F.col("toxic") != 0).cast("int").alias("bad"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id", "bad").limit(sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("text", "bad").mapInArrow(thrifty(_featurize), "features array<long>, bad int")
    rows = table(rows.withColumn("key", F.xxhash64("features")).dropDuplicates(["key", "bad"]), "features")
    m, toxic = rows.agg(F.count("*"), F.sum("bad")).first()
    if not toxic or toxic == m:
        return fit_telling([], np.empty(0, np.int64))
    counts = table(rows.select("bad", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("bad").alias("of")), "counts")
    kept = counts.where(telling(F.col("n"), F.col("of"), toxic / m, counts.count())).select("f")
    names = np.array(sorted(r[0] for r in kept.collect()), np.int64)
    if not len(names):
        return fit_telling([], names)
    held = rows.select("key", "bad", F.explode("features").alias("f")).join(small(kept), "f").groupBy("key", "bad").agg(F.sort_array(F.collect_list("f")).alias("own"))
    found = {(r["key"], r["bad"]): np.array(r["own"], np.int64) for r in held.collect()}
    return fit_telling([(found.get((r["key"], r["bad"]), np.empty(0, np.int64)), r["bad"]) for r in rows.select("key", "bad").collect()], names)


def _score(model, names: list[str], where: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in (x for whole in batches for x in parts(whole, where)):
            found = [own.severity(t) for t in batch.column(where).to_pylist()]
            cols = [*batch.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([round(s) for s, _ in found], pa.int32()), pa.array([p[0] >= 0.5 for _, p in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *names])

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, prefix: str = "") -> DataFrame:
    """Every column of documents with severity (expected, 0 to 2), grade (severity rounded) and toxic (P(grade >= 1) is a half or more).

    The three names begin with prefix; columns of these names are replaced. Null and empty texts have no features and score by
    the thresholds alone. Rows that repeat count as they are; an empty table gives no rows; labels of one grade only reject nothing.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, sample))
    names = [f"{prefix}{n}" for n in ("severity", "grade", "toxic")]
    documents = documents.drop(*names)
    out = documents.withColumns(dict(zip(names, (F.lit(0.0), F.lit(0), F.lit(False)), strict=True))).schema
    return documents.mapInArrow(thrifty(_score(model, names, documents.columns.index("text"))), out)
