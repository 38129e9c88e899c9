"""Toxicity by a factorization machine over hashed terms.

A term is a word or the beginning of one, seen at least 1, 2, 4 or 8 times in the
text; it is hashed to one of BUCKETS numbers.  The log-odds of a text are

    bias + sum of weights + sum over pairs of terms of the product of their factors,

so a pair (an insult and a group that it is meant for) can weigh what neither
term does.  Terms are counted by label in Spark; those whose texts are toxic more
or less often than chance explains go into the machine, which is fitted on a
bounded sample of labelled texts and then scores every text in Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

#: Labelled texts that the model is fitted on at most, chosen by a hash of the id.
LABELLED = 8_000
BUCKETS, LEVELS, BEGINNINGS = 1 << 22, (1, 2, 4, 8), (4, 5, 6, 7)
#: Texts of the sample that a term is in at least (as a number and as a share), and deviations that its share of toxic texts is off by.
LEAST_TEXTS, LEAST_SHARE, DEVIATIONS = 5, 0.002, 3.5
#: Factors of a term, steps of the fit, their size and the penalties of weights and factors.
FACTORS, STEPS, RATE, PENALTY = 8, 150, 0.05, (2e-4, 2e-3)
#: From this score on a text is told toxic.
TOXIC = 0.3
WORD = re.compile(r"\w+")
#: Words whose buckets a task remembers.
REMEMBERED = 1 << 18


class Terms:
    """The buckets of texts; remembers those of words, as most words come again.

    A term's hash gives its first bucket, its levels follow on that.
    """

    def __init__(self, kept: np.ndarray | None = None):
        self.number = None if kept is None else {int(b): k for k, b in enumerate(kept)}
        self.first = None if kept is None else {b - b % len(LEVELS) for b in self.number}
        self.known: dict[str, tuple] = {}

    def _of(self, word: str) -> tuple:
        """First buckets of the word's terms, where any is kept."""
        n = len(LEVELS)
        found = (xxhash.xxh64_intdigest(t) % (BUCKETS // n) * n for t in ("=" + word, *("<" + word[:k] for k in BEGINNINGS if k <= len(word))))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = out = tuple(b for b in found if self.first is None or b in self.first)
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Distinct buckets (or numbers of kept ones) of a text."""
        seen: dict[int, int] = {}
        known = self.known
        for word, n in Counter(m.group() for m in WORD.finditer((text or "").lower())).items():
            buckets = known.get(word)
            for b in self._of(word) if buckets is None else buckets:
                seen[b] = seen.get(b, 0) + n
        found = (b + k for b, n in seen.items() for k, level in enumerate(LEVELS) if n >= level)
        return np.array(sorted(found if self.number is None else (self.number[b] for b in found if b in self.number)), np.int64)


class Machine:
    """A factorization machine over presence of terms."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of each row of term numbers."""
        at = np.concatenate([*rows, np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return _logistic(self._odds(row, at, len(rows))[0])

    def _odds(self, row, at, n):
        v = self.factors[at]
        total = np.stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])], axis=1)
        alone = np.bincount(row, (v * v).sum(axis=1), n)
        return self.bias + np.bincount(row, self.weights[at], n) + ((total**2).sum(axis=1) - alone) / 2, total


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fitted(rows: list[np.ndarray], toxic: np.ndarray, terms: int, factors: int = FACTORS, steps: int = STEPS, rate: float = RATE, penalty=PENALTY, seed: int = 12) -> Machine:
    """Logistic loss and squared penalties, by Adam over all rows a step; the same rows give the same machine."""
    n, y = len(rows), np.asarray(toxic, float)
    rate_of = float(np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4))
    machine = Machine(float(np.log(rate_of / (1 - rate_of))), np.zeros(terms), np.random.default_rng(seed).normal(0, 0.1, (terms, factors)))
    if not n or not terms or y.min() == y.max():
        machine.factors[:] = 0
        return machine
    at = np.concatenate(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    means = [0.0, np.zeros(terms), np.zeros((terms, factors))]
    squares = [0.0, np.zeros(terms), np.zeros((terms, factors))]
    for step in range(1, steps + 1):
        odds, total = machine._odds(row, at, n)
        off = (_logistic(odds) - y) / n
        g = off[row]
        own = machine.factors[at]
        pull = g[:, None] * (total[row] - own)
        grads = [off.sum(), np.bincount(at, g, terms) + penalty[0] * machine.weights, np.stack([np.bincount(at, pull[:, f], terms) for f in range(factors)], axis=1) + penalty[1] * machine.factors]
        for k, grad in enumerate(grads):
            means[k] = 0.9 * means[k] + 0.1 * grad
            squares[k] = 0.999 * squares[k] + 0.001 * grad * grad
            move = rate * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)
            if k == 0:
                machine.bias -= float(move)
            elif k == 1:
                machine.weights -= move
            else:
                machine.factors -= move
    return machine


def telling(counts: DataFrame, clean: int, toxic: int) -> list[int]:
    """Buckets of counts (bucket, clean, toxic: texts) whose share of toxic texts is off by DEVIATIONS or more; bounded by the sample."""
    n = F.col("clean") + F.col("toxic")
    all_ = clean + toxic
    gap = F.col("toxic") / toxic - F.col("clean") / clean
    spread = F.sqrt((n + 1) / all_ * (1 - n / (all_ + 2)) * (1 / toxic + 1 / clean))
    return sorted(r.bucket for r in counts.where((n >= max(LEAST_TEXTS, LEAST_SHARE * all_)) & (F.abs(gap) >= DEVIATIONS * spread)).select("bucket").collect())


def learned(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[np.ndarray, Machine]:
    """(kept buckets, machine) from docs (doc_id, text) and labels (doc_id, toxic) whose crc32(doc_id) mod 4 isn't 2.

    Labels other than 0 and 1 and without an id are no labels; of contrary
    labels of an id each counts.  Of more than `labelled` labels those with the
    smallest hashes of their ids are taken.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    good = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    some = good.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # `labelled` rows of two numbers

    def count(batches):
        terms, seen = Terms(), np.zeros((2, BUCKETS), np.int32)
        n = [0, 0]
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen[toxic][terms.of(text)] += 1
                n[toxic] += 1
        at = np.flatnonzero(seen[0] + seen[1])
        at = np.r_[-1, at]  # bucket -1 counts the texts
        values = [np.r_[n[k], seen[k][at[1:]]].astype(np.int64) for k in (0, 1)]
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), *(pa.array(v[i : i + (1 << 16)]) for v in values)], names=["bucket", "clean", "toxic"])

    counts = rows.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    try:
        sizes = counts.where("bucket = -1").first()
        kept = telling(counts.where("bucket >= 0"), sizes.clean, sizes.toxic) if sizes and sizes.clean and sizes.toxic else []
    finally:
        counts.unpersist()
    kept = np.array(kept, np.int64)

    def numbers(batches):
        terms = Terms(kept)
        for b in batches:
            found = [terms.of(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "toxic", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = rows.mapInArrow(numbers, f"doc_id {kind}, toxic int, terms array<long>").orderBy("doc_id", "toxic", "terms").collect()  # term numbers of the sample
    return kept, fitted([np.array(r.terms, np.int64) for r in sample], np.array([r.toxic for r in sample]), len(kept))


def scored(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text).

    held_out rows (crc32 of the id's text mod 4 is 2) train nothing.  A null,
    empty or unknown text gets the score of a text without terms.  Where no or
    only one label is known all scores are that label's (smoothed) rate.  Ids
    may be null (never held out, never labelled) and repeat; every row gives
    one row; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept, machine = learned(docs, labels, labelled)
    model = spark.sparkContext.broadcast((kept, machine))  # bounded by the sample
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        kept, machine = model.value
        terms = Terms(kept)
        for b in batches:
            score = machine.scores([terms.of(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= TOXIC).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; odd rows as in `scored`."""
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
