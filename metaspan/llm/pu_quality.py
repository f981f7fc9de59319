"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are training rows labelled 1; the unlabelled set is web text drawn from the whole corpus without its
labels. With class prior pi, loss l and scorer g the risk is

    pi * mean_P l(g, +1)  +  max(0, mean_U l(g, -1) - pi * mean_P l(g, -1));

when the second part falls below zero, its own gradient is followed upwards, as non-negative PU learning does. The prior
comes from the trusted positives and the unlabelled texts alone (class_prior); rows labelled 0 take no part in the fit. The
scorer is linear in byte statistics of the whole text.

Features: for each text, shares of byte classes and of pairs of neighbouring byte classes, plus ratios of shape
and of repeated words; all from whole texts, in numpy. Labels, language, source and id are never features. Only the fit uses a sample, of a fixed,
documented size; scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from metaspan.llm import bytesops as bo
from metaspan.llm.scratch import prepare, table, written

#: Bounds of the fit's samples, in rows.
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Byte -> one of 24 classes."""
    c = np.full(256, 23, np.int64)  # other control and symbol bytes
    c[ord("a") : ord("z") + 1] = 0
    c[ord("A") : ord("Z") + 1] = 1
    c[ord("0") : ord("9") + 1] = 2
    c[0x80:0xC0] = 3
    c[0xC0:] = 4
    for k, ch in enumerate(" \n\t.,!?|#$%&*-_/:"):
        c[ord(ch)] = 5 + k
    for ch in "'\"()[]{}<>;":
        c[ord(ch)] = 22
    return c


_CLASS = _classes()
KINDS = 24
SHAPES = 9
WIDTH = KINDS + KINDS * KINDS + SHAPES


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of WIDTH numbers per text; an empty text has all zeros."""
    rows = len(at) - 1
    out = np.zeros((rows, WIDTH), np.float32)
    kind = _CLASS[data]
    pair = kind[:-1] * KINDS + kind[1:] if len(kind) else kind
    doc, word, _, _ = bo.word_hashes(data, at)
    first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=rows))))
    for i in range(rows):
        a, b = at[i], at[i + 1]
        n = b - a
        if not n:
            continue
        single = np.bincount(kind[a:b], minlength=KINDS)
        out[i, :KINDS] = np.sqrt(single / n)
        if n > 1:
            out[i, KINDS : KINDS + KINDS * KINDS] = np.sqrt(np.bincount(pair[a : b - 1], minlength=KINDS * KINDS) / (n - 1))
        words = single[5] + single[6] + single[7] + 1
        lines = single[6] + 1
        own = word[first[i] : first[i + 1]]
        many = max(1, len(own) - 1)
        # words that repeat the one before, words whose pair was there before, and distinct words
        again = np.count_nonzero(own[1:] == own[:-1]) / many
        pairs = 1 - len(np.unique(own[1:] + own[:-1] * bo.U64(3))) / many if len(own) > 1 else 0.0
        out[i, -SHAPES:] = (np.sqrt(again), pairs, len(np.unique(own)) / max(1, len(own)), np.log1p(n) / 12, min(1, n / words / 20), min(1, n / lines / 500), min(1, single[8] / words), min(1, single[10:].sum() / words), np.count_nonzero(single) / KINDS)
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(data, at) for _, _, data, at in bo.chunks(batch.column("text"))]
        x = np.concatenate(found) if found else np.zeros((0, WIDTH), np.float32)
        yield pa.record_batch([batch.column("positive"), pa.array([r.tobytes() for r in x], pa.binary())], ["positive", "x"])


@dataclass(frozen=True)
class Model:
    """A fitted scorer: score = sigmoid((x - mean) / scale . weight + bias). Without positives the score is the prior."""

    prior: float
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def pu_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, negative part) of the risk with the logistic loss, from the margins of positives and unlabelled; the
    non-negative risk is the first plus the larger of the second and 0."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def pu_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What the fit goes against, by margin: the gradient of the whole risk, or, where the negative part is below 0, that of
    the positive part less that of the negative part."""
    sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
    way = 1.0 if pu_risk(zp, zu, prior)[1] >= 0 else -1.0
    # of l(g, +1) the derivative is s - 1, of l(g, -1) it is s
    up = prior * (sp - 1) / len(zp)
    return (up - prior * sp / len(zp) if way > 0 else up + prior * sp / len(zp)), way * su / len(zu)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4, settled: float = 1e-6) -> Model:
    """Minimise the non-negative PU risk by Adam over whole batches, until the risk's mean over 20 steps falls by less than
    `settled`; deterministic."""
    both = np.concatenate((positive, unlabelled)) if len(positive) or len(unlabelled) else np.zeros((1, WIDTH), np.float32)
    mean, scale = both.mean(0), both.std(0) + 0.02
    start = float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return Model(prior, mean, scale, np.zeros(both.shape[1], np.float32), start)
    xp, xu = (((x - mean) / scale).astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(both.shape[1] + 1, np.float32)
    w[-1] = start
    m, v = np.zeros_like(w), np.zeros_like(w)
    past: list[float] = []
    for t in range(1, steps + 1):
        zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        parts = pu_risk(zp, zu, prior)
        past.append(parts[0] + max(0.0, parts[1]))
        if t > 60 and np.mean(past[-40:-20]) - np.mean(past[-20:]) < settled:
            break
        dp, du = (d.astype(np.float32) for d in pu_gradient(zp, zu, prior))
        g = np.concatenate((dp @ xp + du @ xu, [dp.sum() + du.sum()])).astype(np.float32)
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(prior, mean, scale, w[:-1], float(w[-1]))


def mixture_share(sp: np.ndarray, su: np.ndarray, risk: float = 0.1) -> float:
    """The share of positives among unlabelled texts, from scores of positives and unlabelled that no fit has seen.

    Above a cut the unlabelled hold at least their positives: share <= P(su >= cut) / P(sp >= cut). The cut is the one with
    the least upper confidence bound of that quotient, where nearly all that is left are positives.
    """
    cuts = np.unique(sp)
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, "left") / len(s)
    qp, qu = above(sp), above(su)
    slack = np.sqrt(np.log(4 / risk) / 2) * (len(su) ** -0.5 + len(sp) ** -0.5)
    best = int(np.argmin((qu + slack) / qp))
    return float(qu[best] / qp[best])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, cuts: int = 4) -> float:
    """The prior from features of positives and unlabelled: a scorer that tells the two apart is fitted on half of each, and
    the share is read off its scores of the other half; the mean over `cuts` halvings, either half being fitted on. Without
    enough rows of either, 0.5."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    shares = []
    for cut in range(cuts):
        rng = np.random.default_rng(cut)
        halves = [(x[o[::2]], x[o[1::2]]) for x, o in ((x, rng.permutation(len(x))) for x in (positive, unlabelled))]
        for k in (0, 1):
            model = fit_nnpu(halves[0][k], halves[1][k], 0.5, steps=150, ridge=1e-3)
            shares.append(mixture_share(model.score(halves[0][1 - k]), model.score(halves[1][1 - k])))
    least = 1 / (len(unlabelled) + 2)
    return min(1 - least, max(least, float(np.mean(shares))))


def held_out(doc_id: Column) -> Column:
    """The test fold: crc32 of the id as text, modulo 5, is 0. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, aside: int | None = None) -> Model:
    """Fit on the training fold. Samples are the rows of least id hash, at most the given numbers of each. `aside` leaves a
    further remainder of the folds' hash (1 to 4) out, for choices between models. A doc_id that is no whole number names
    no document: such rows have no part in the fit."""
    prepare(docs.sparkSession)
    number = lambda c: F.expr(f"try_cast({c} as bigint)").alias("doc_id")
    ours = ~held_out(F.col("doc_id"))
    if aside is not None:
        ours = ours & (F.crc32(F.col("doc_id").cast("string")) % 5 != aside)
    marks = labels.select(number("doc_id"), F.col("quality").cast("int").alias("q"))
    marks = marks.filter("doc_id is not null and q is not null").filter(ours).groupBy("doc_id").agg(F.min("q").alias("q"))
    n_pos = marks.filter("q = 1").count()
    ids = docs.select(number("doc_id")).filter("doc_id is not null").filter(ours)
    n_docs = ids.count()

    def sample(frame: DataFrame, bound: int, count: int, positive: int) -> DataFrame:
        h = F.pmod(F.xxhash64("doc_id", F.lit(positive)), F.lit(1 << 30))
        rate = 1.0 if count <= bound else 1.2 * bound / count  # so that few rows are ordered
        kept = frame.filter(h < int(rate * (1 << 30))).select("doc_id", h.alias("h"), F.lit(positive).alias("positive"))
        return kept.orderBy("h", "doc_id").limit(bound).select("doc_id", "positive")

    chosen = sample(marks.filter("q = 1"), max_positive, n_pos, 1).unionByName(sample(ids, max_unlabelled, n_docs, 0))
    chosen = written(chosen, "sample")  # at most max_positive + max_unlabelled rows of two numbers: safe to broadcast
    texts = docs.select(number("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text")
    texts = texts.dropDuplicates(["doc_id", "positive"])
    rows = texts.select("positive", "text").mapInArrow(_feature_rows, "positive int, x binary").collect()
    rows.sort(key=lambda r: (r.positive, bytes(r.x)))  # the sums below must not depend on the order of tasks
    take = lambda k: np.array([np.frombuffer(r.x, np.float32) for r in rows if r.positive == k], np.float32).reshape(-1, WIDTH)
    positive, unlabelled = take(1), take(0)
    for x in (positive, unlabelled):  # sorted rows in a fixed, arbitrary order, so that halves are alike
        np.random.default_rng(0).shuffle(x)
    return fit_nnpu(positive, unlabelled, class_prior(positive, unlabelled))


def _score_rows(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(features(data, at)) for _, _, data, at in bo.chunks(batch.column("text"))]
            s = np.concatenate(found) if found else np.zeros(0)
            yield pa.record_batch([batch.column("row"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["row", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows with score and predicted appended. Columns of these two names are replaced, all others pass whatever their
    names; null texts score as empty ones; repeated rows score alike; an empty table gives none."""
    prepare(docs.sparkSession)
    kept = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in ("score", "predicted")]
    rows = docs.select(F.struct(*kept).alias("row"), F.col("text"))
    kind = StructType([rows.schema["row"], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(_score_rows(model, threshold), kind).select("row.*", "score", "predicted")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: a score for every whole text of `documents`."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
    return scored.select("doc_id", "held_out", "score", "predicted")
