"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over hashed words and word beginnings, trained with numpy on
confirmed toxic texts and unlabelled ones.  The risk of a classifier is
prior * R(toxic, +) + max(0, R(unlabelled, -) - prior * R(toxic, -)), which corrects
the unlabelled texts for the share of toxic ones among them; where the second term
goes below zero the step climbs it instead, so that it can't overfit below nothing.
Only features that toxic texts have clearly more often (by the likelihood ratio) get a
weight, so that long clean texts don't drift by the sum of many small ones.
Three classifiers, each blind to a third of the sample, give honest scores there;
those set the cut that becomes score 0.7.

Defined cases: a null text is an empty one; a label that is null, or of a document
that isn't there, counts for nothing, and the largest of a document's labels holds;
without a confirmed toxic text to learn from every score is 0.  Ties don't arise and
rows repeat as they come.  Only doc_id and text (and toxic of the labels) are read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_batches, unit_hash

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (5, 6, 7)
DIM_BITS = 18
#: Bounds of the sample that is learned from: confirmed toxic texts, and unlabelled ones.
POSITIVES, UNLABELLED = 2000, 6000
FOLDS, STEPS, RATE, DECAY, DEFAULT_PRIOR = 3, 200, 0.1, 1e-4, 0.1
#: Least likelihood ratio, and least number of toxic texts, of a feature that gets a weight.
LEAST_RATIO, LEAST_TEXTS = 14.0, 3
THRESHOLD = 0.7
#: Least precision, as the class prior tells it, of a cut.
LEAST_PRECISION = 0.5
#: Words whose weight a worker remembers.
MEMORY = 100_000


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: the word itself and its beginnings."""
    top = (1 << DIM_BITS) - 1
    raw = word.encode()
    return [zlib.crc32(raw) & top] + [zlib.crc32(word[:n].encode(), 77) & top for n in BEGINNINGS if len(word) > n]


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class ToxicityModel:
    """`weights` is the mean of the folds' classifiers; cut and slope map a margin to a score."""

    weights: np.ndarray
    bias: float
    cut: float
    slope: float

    @property
    def empty(self) -> bool:
        return not len(self.weights)

    def score(self, margin: float) -> float:
        x = self.slope * (margin - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


class _Rows:
    """Sparse rows: `index` has the features of row i from starts[i] on."""

    def __init__(self, parts: list[np.ndarray]):
        self.n = len(parts)
        self.index = np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int64)
        self.of = np.repeat(np.arange(self.n), [len(p) for p in parts])

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.of, weights=w[self.index], minlength=self.n) + b

    def back(self, slopes: np.ndarray, dim: int) -> np.ndarray:
        return np.bincount(self.index, weights=slopes[self.of], minlength=dim)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], dim: int) -> np.ndarray:
    """The features that clearly more of the positives have, by the G statistic of the two rates."""

    def texts(rows: list[np.ndarray]) -> np.ndarray:
        n = np.zeros(dim)
        for r in rows:
            n[np.unique(r)] += 1
        return n

    a, b, na, nb = texts(positive), texts(unlabelled), len(positive), len(unlabelled)
    both = (a + b) / (na + nb)

    def part(k: np.ndarray, n: int) -> np.ndarray:
        return k * np.log(np.maximum(k, 1e-12) / np.maximum(n * both, 1e-12)) + (n - k) * np.log(
            np.maximum(n - k, 1e-12) / np.maximum(n * (1 - both), 1e-12)
        )

    ratio = 2 * (part(a, na) + part(b, nb))
    return np.flatnonzero((ratio >= LEAST_RATIO) & (a >= LEAST_TEXTS) & (a / na > 2 * b / nb))


def train_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS, risk: str = "nnpu"
) -> tuple[np.ndarray, float]:
    """A linear classifier of least non-negative PU risk, by full-batch Adam on the logistic loss.

    For comparison: risk "pu" leaves out the correction below zero, "pn" takes all unlabelled
    texts as negative.
    """
    dim = 1 << DIM_BITS
    kept = telling(positive, unlabelled, dim)
    to = np.full(dim, -1, np.int64)
    to[kept] = np.arange(len(kept))
    narrow = lambda x: [(lambda r: r[r >= 0])(to[r]) for r in x]
    p, u, k = _Rows(narrow(positive)), _Rows(narrow(unlabelled)), len(kept)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, steps + 1):
        sp, su = _sigmoid(p.margins(w, b)), _sigmoid(u.margins(w, b))
        negative = np.mean(-np.log(1 - su + 1e-12)) - prior * np.mean(-np.log(1 - sp + 1e-12))
        down_p, up_p, down_u = (sp - 1) / p.n, sp / p.n, su / u.n
        if risk == "pn":
            gp, gu = prior * down_p, (1 - prior) * down_u
        elif negative >= 0 or risk == "pu":
            gp, gu = prior * down_p - prior * up_p, down_u
        else:  # climbs the part that has gone below zero
            gp, gu = prior * up_p, -down_u
        g = p.back(gp, k) + u.back(gu, k) + DECAY * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= fix * m / (np.sqrt(v) + 1e-8)
        b -= fix * mb / (np.sqrt(vb) + 1e-8)
    full = np.zeros(dim)
    full[kept] = w
    return full, b


def _cut(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The margin of the best F1 as positives and unlabelled texts tell it.

    Where nothing flags more toxic texts than others, the cut lies above all margins, so
    that clean texts stay.
    """
    best, at = -1.0, None
    up, uu = np.sort(p), np.sort(u)
    for c in np.unique(np.concatenate([p, u])):
        recall = 1 - np.searchsorted(up, c) / len(up)
        flagged = 1 - np.searchsorted(uu, c) / len(uu)
        precision = min(1.0, prior * recall / max(flagged, 1e-9))
        f1 = 2 * precision * recall / max(precision + recall, 1e-9)
        if precision >= LEAST_PRECISION and recall > 0 and f1 > best:
            best, at = f1, float(c)
    below = uu[uu < at] if at is not None else []
    if not len(below):
        return float(max(up[-1], uu[-1])) + 1.0
    return (at + float(below[-1])) / 2


def fit(sample: list[tuple[bool, np.ndarray]], prior: float) -> ToxicityModel:
    """sample: for each text whether it is confirmed toxic, and its features."""
    pos, unl = [x for t, x in sample if t], [x for t, x in sample if not t]
    if len(pos) < FOLDS or len(unl) < FOLDS:
        return ToxicityModel(np.zeros(0), 0.0, 0.0, 1.0)
    prior = min(max(prior, 0.005), 0.5)
    models, zp, zu = [], np.zeros(len(pos)), np.zeros(len(unl))
    for k in range(FOLDS):
        rest = lambda x: [r for i, r in enumerate(x) if i % FOLDS != k]  # noqa: B023, E731
        w, b = train_nnpu(rest(pos), rest(unl), prior)
        models.append((w, b))
        margin = lambda x: np.array([w[r].sum() + b for r in x])  # noqa: B023, E731
        zp[k::FOLDS], zu[k::FOLDS] = margin(pos[k::FOLDS]), margin(unl[k::FOLDS])
    cut = _cut(zp, zu, prior)
    spread = max(1e-6, float(np.median(zp[zp >= cut]) - cut) if (zp >= cut).any() else 1.0)
    return ToxicityModel(np.mean([w for w, _ in models], 0).astype(np.float32), float(np.mean([b for _, b in models])), cut, 2.0 / spread)


def _featured(batches):
    for batch in batches:
        rows = [np.fromiter((i for w in sorted(words(t.as_py())) for i in features(w)), np.int32).tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "toxic", "x"])


def learn_toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicityModel:
    """Fit on at most `positives` confirmed toxic texts and about `unlabelled` others.

    Both are picked by a hash of doc_id among the ids that may be learned from; the
    class prior is the share of toxic ones among those labels.  The sample, and so
    what reaches the driver, is bounded by the two parameters.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    ).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    if not told["p"]:
        return ToxicityModel(np.zeros(0), 0.0, 0.0, 1.0)
    prior = told["p"] / told["n"] if told["n"] > told["p"] else DEFAULT_PRIOR
    chosen = known.filter("toxic = 1").orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(positives).select("doc_id")
    ids = [r[0] for r in chosen.collect()]  # at most `positives` numbers
    chosen = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    n = docs.count()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hit = base.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", F.lit(True).alias("toxic"), "text")
    rest = base.filter(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (unit_hash(F.col("doc_id"), "unlabelled") < min(1.0, 1.5 * unlabelled / max(n, 1)))
    ).select("doc_id", F.lit(False).alias("toxic"), "text")
    got = hit.unionByName(rest).mapInArrow(_featured, "doc_id long, toxic boolean, x binary").collect()
    rows = sorted(((r["doc_id"], r["toxic"], bytes(r["x"])) for r in got), key=lambda r: (zlib.crc32(str(r[0]).encode(), 5), r))
    return fit([(t, np.frombuffer(x, np.int32)) for _, t, x in rows], prior)


class _Scorer:
    """Scores texts; remembers what a word adds."""

    def __init__(self, model: ToxicityModel):
        self.model, self.adds = model, {}

    def __call__(self, text: str | None) -> float:
        if self.model.empty:
            return 0.0
        adds, weights, z = self.adds, self.model.weights, self.model.bias
        for w in words(text):
            x = adds.get(w)
            if x is None:
                x = float(sum(weights[i] for i in features(w)))
                if len(adds) < MEMORY:
                    adds[w] = x
            z += x
        return self.model.score(z)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB: the number of weights is fixed

    def run(batches):
        scorer = _Scorer(shared.value)
        for batch in batches:
            score = [scorer(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold; columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(batches):
        scorer = _Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
