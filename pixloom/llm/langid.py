"""Language identification by prediction by partial matching.

Every language has a variable-order context tree over the bytes of lower-cased
training text: a context of up to ORDER bytes is kept if it occurs there often enough.
A byte that a context has seen costs -log2(count / (total + kinds)), any other
byte costs the escape -log2(kinds / (total + kinds)) and then what the next
shorter context says (method C), down to 1/256.  Statistics are frozen, so the
cost of every (context, byte) is tabulated once over the union of the trees of a few
languages, and a text's exact code length is a sum of table look-ups: each position
walks from the root to its longest context, in numpy over many texts.  Languages that
share a table don't change each other's costs, so any number of them may be learned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

ORDER = 4
#: Bounds of the labelled sample: bytes of text that a language gets, and that all get together (beyond it each still has a text).
TRAIN_BYTES, ALL_BYTES = 1 << 19, 1 << 23
#: Occurrences in a language's sample from which a context is kept.  A language keeps at most (ORDER + 1) * bytes / LEAST_COUNT contexts.
LEAST_COUNT = 24
#: Languages that share a table: it has a row for each context of any of them, so more would leave it mostly idle.
TOGETHER = 8
#: Bytes of text that are scored together; longer texts go in pieces that know the ORDER bytes before them.
SEGMENT = 1 << 20
WORDLIKE = re.compile(r"[^\W\d_]")


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """The order bytes before each position from `order` on, the nearest in the lowest byte."""
    out = np.zeros(len(data) - order, np.uint64)
    for d in range(order, 0, -1):
        out = (out << np.uint64(8)) | data[order - d : len(data) - d].astype(np.uint64)
    return out


def has_letter(text: str) -> bool:
    """Whether a character is a letter (superscripts and fractions, which a pattern takes for one, aren't)."""
    return any(m.group().isalpha() for m in WORDLIKE.finditer(text))


class Trees:
    """The cost table of a few languages, in alphabetical order."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, least: int = LEAST_COUNT):
        self.langs, self.order = sorted(samples), order
        texts = [np.frombuffer(b"\n".join(samples[k]) + b"\n", np.uint8) for k in self.langs]
        used = np.unique(np.concatenate([*texts, np.zeros(0, np.uint8)]))
        self.code = np.full(256, len(used), np.int64)  # bytes never seen share a code
        self.code[used] = np.arange(len(used))
        size, n = len(used) + 1, len(self.langs)
        counts = []  # by order: (language, context, symbol, count)
        for d in range(order + 1):
            rows = []
            for k, t in enumerate(texts):
                if len(t) > d:
                    both, c = np.unique((_codes(t, d) << np.uint64(8)) | t[d:].astype(np.uint64), return_counts=True)
                    rows.append((np.full(len(c), k), both >> np.uint64(8), self.code[(both & np.uint64(255)).astype(np.int64)], c))
            counts.append([np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4)
        for d in range(1, order + 1):
            often = self._often(*counts[d][:2], counts[d][3], least)
            counts[d] = [x[often] for x in counts[d]]
        kept = [np.unique(c[1]).astype(np.uint64) for c in counts]
        first = np.cumsum([0, *(len(x) for x in kept)])
        total = max(1, int(first[-1]))
        cost = np.empty((total, size, n))
        self.child = np.zeros((total, size), np.int32)
        cost[0] = 8.0
        for d in range(order + 1):
            here, (lang, context, symbol, c) = kept[d], counts[d]
            if not len(here):
                break
            if d:
                shorter = np.uint64((1 << (8 * (d - 1))) - 1)
                parent = first[d - 1] + np.searchsorted(kept[d - 1], here & shorter)
                oldest = self.code[(here >> np.uint64(8 * (d - 1))).astype(np.int64)]
                self.child[parent, oldest] = np.arange(first[d], first[d + 1])
                cost[first[d] : first[d + 1]] = cost[parent]
            row, c = first[d] + np.searchsorted(here, context), c.astype(float)
            seen, kinds = np.zeros((total, n)), np.zeros((total, n))
            np.add.at(seen, (row, lang), c)
            np.add.at(kinds, (row, lang), 1)
            own = np.nonzero(kinds)
            escape = -np.log2(kinds[own] / (seen[own] + kinds[own]))
            cost[own[0], :, own[1]] += escape[:, None]
            cost[row, symbol, lang] = -np.log2(c / (seen[row, lang] + kinds[row, lang]))
        self.cost = np.ascontiguousarray(cost.reshape(total * size, n), dtype=np.float32)
        self.size = size

    @staticmethod
    def _often(lang, context, count, least) -> np.ndarray:
        """Which rows are of a context that occurs `least` times in the row's language."""
        out = np.zeros(len(lang), bool)
        if len(lang):
            by = np.lexsort((context, lang))
            new = np.r_[True, (lang[by][1:] != lang[by][:-1]) | (context[by][1:] != context[by][:-1])]
            out[by] = (np.add.reduceat(count[by], np.nonzero(new)[0]) >= least)[np.cumsum(new) - 1]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language; texts of up to SEGMENT bytes together."""
        gap, n = self.order, len(self.langs)
        size = np.array([len(t) + gap for t in texts])
        other = bytes([0]) * gap
        data = np.frombuffer(b"".join(other + t for t in texts), np.uint8)
        codes = self.code[data]
        begin = np.cumsum(size) - size
        pad = (begin[:, None] + np.arange(gap)).ravel()
        codes[pad] = self.size - 1
        return self._sums(codes, pad, begin, n)

    def _sums(self, codes, pad, begin, n):
        at, alive = np.zeros(len(codes), np.int32), None
        for d in range(1, self.order + 1):
            ext = np.zeros(len(codes), np.int32)
            ext[d:] = self.child[at[d:], codes[:-d]]
            ok = ext > 0
            alive = ok if alive is None else alive & ok
            at = np.where(alive, ext, at)
        bits = self.cost[at.astype(np.int64) * self.size + codes]
        bits[pad] = 0
        return np.add.reduceat(bits, begin, axis=0, dtype=np.float64) if len(begin) else np.zeros((0, n))

    def long(self, text: bytes) -> np.ndarray:
        """Bits of one long text, piece by piece."""
        total = np.zeros(len(self.langs))
        for a in range(0, len(text), SEGMENT):
            part = text[max(0, a - self.order) : a + SEGMENT]
            skip = min(a, self.order)
            codes = self.code[np.frombuffer(part, np.uint8)]
            if not skip:
                total += self.lengths([part])[0]
            else:
                total += self._sums(codes, np.arange(skip), np.array([0]), len(self.langs))[0]
        return total


class Model:
    """Languages in alphabetical order, TOGETHER of them to a table."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, least: int = LEAST_COUNT):
        self.langs = sorted(samples)
        self.parts = [Trees({k: samples[k] for k in self.langs[j : j + TOGETHER]}, order, least) for j in range(0, len(self.langs), TOGETHER)]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language; texts of up to SEGMENT bytes together."""
        return np.concatenate([p.lengths(texts) for p in self.parts], axis=1)

    def long(self, text: bytes) -> np.ndarray:
        """Bits of one long text, piece by piece."""
        return np.concatenate([p.long(text) for p in self.parts])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: score is its share of probability, at equal priors; ("und", 0) without letters."""
        out, todo, held, size = [("und", 0.0)] * len(texts), [], [], 0

        def settle(where, bits):
            for k, b in zip(where, bits, strict=True):
                best = int(np.argmin(b))
                out[k] = self.langs[best], float(1 / np.exp2(np.maximum(b[best] - b, -1000)).sum())

        for k, t in enumerate(texts):
            if not self.langs or not t or not has_letter(t):
                continue
            t = t.lower().encode()
            if len(t) > SEGMENT:
                settle([k], [self.long(t)])
                continue
            if size + len(t) > SEGMENT:
                settle(todo, self.lengths(held))
                todo, held, size = [], [], 0
            todo.append(k)
            held.append(t)
            size += len(t)
        if todo:
            settle(todo, self.lengths(held))
        return out


def sample(docs: DataFrame, most: int = TRAIN_BYTES, total: int = ALL_BYTES) -> dict[str, list[bytes]]:
    """Whole lower-cased texts by language, chosen by a hash of the id: about `most` bytes of each (its share of total), twice that at the utmost.

    Every language has a text at least, however many there are and however long it is.
    """
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("remainder") != 2)).withColumn("rank", rank)
    sizes = {r.lang: (r.n, r.first) for r in train.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.min("rank").alias("first")).collect()}  # a row a language
    if not sizes:
        return {}
    most = min(most, total // len(sizes))
    share = F.create_map(*(F.lit(x) for k, (n, first) in sizes.items() for x in (k, max(first, min(1.0, most / max(1, n))))))
    rows = train.where(F.col("rank") <= share[F.col("lang")]).select("lang", "rank", "text")
    out, held = {}, {}
    for r in sorted(rows.toLocalIterator(), key=lambda r: (r.lang, r.rank, r.text)):
        t = r.text.lower().encode()
        if not held.get(r.lang) or held[r.lang] + len(t) <= 2 * most:
            out.setdefault(r.lang, []).append(t)
            held[r.lang] = held.get(r.lang, 0) + len(t)
    return out


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang).

    held_out rows (crc32 of the id's text mod 4 is 2) and rows without an id or
    lang train nothing.  Null, empty and letterless texts are "und" with score 0,
    as is all text where nothing trains.  Ties go to the first language by name.
    Repeated rows are kept, each with its prediction; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marked = docs.select("doc_id", "text", "lang", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)).alias("remainder"))
    model = spark.sparkContext.broadcast(Model(sample(marked)))  # bounded by the sample's bounds
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = model.value.predict(b.column("text").to_pylist())
            lang, score = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.col("remainder") == 2, F.lit(False)).alias("held_out")
    return marked.select("doc_id", held, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """Language and score of every document; odd rows as in `identified`."""
    return identified(documents(spark, sf_dir))
