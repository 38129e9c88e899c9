"""Byte-level BPE by overlapping chunks.

A text of up to one chunk is pre-tokenised where it lies.  A longer one is cut
into overlapping chunks that are pre-tokenised in parallel; from a position that
is a pre-token boundary in both neighbours the matches agree (a match looks at
what follows it only), so the chunks are stitched at the first such position and
each then encodes its own pieces.  Where an overlap holds no common boundary (a
run longer than the overlap) that text is encoded in one piece, which is exact.
Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, partitions, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 32768, 2048
#: Pieces whose ids a worker remembers.
REMEMBERED = 200_000


class Codec:
    """Encodes and decodes by ranks (the content of a rank file) and a pre-token pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.words = {i: b for b, i in self.ranks.items()}
        self.names = {i: str(i) for i in self.words}
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # to this pattern a pre-token is whole, whatever it would be cut into without the text around it
        self.one = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def packed(self, pieces: list[str]) -> bytes:
        """The pieces' ids as 32-bit integers, one after another."""
        known = self.known
        for p in [p for p in set(pieces) if p not in known]:
            if len(known) >= REMEMBERED:
                known.clear()
                return b"".join(array("i", self.one(p)).tobytes() for p in pieces)
            known[p] = array("i", self.one(p)).tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(self.pieces(text))).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


@lru_cache(2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def edges(codec: Codec, chunk: str, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
    """Pre-token boundaries in the chunk's first and last overlap, as offsets; the chunk's ends are none."""
    ends = [m.end() for m in codec.pattern.finditer(chunk)][:-1]
    return [e for e in ends if e <= overlap], [e for e in ends if e >= len(chunk) - overlap]


def encode_from(codec: Codec, chunk: str, start: int, stop: int | None) -> bytes:
    """Packed ids of the pieces of chunk between two true boundaries; the matches still see what follows stop."""
    pieces = []
    for m in codec.pattern.finditer(chunk, start):
        if stop is not None and m.start() >= stop:
            break
        pieces.append(m.group())
    return codec.packed(pieces)


def lists(packed: list[bytes]) -> pa.ListArray:
    """An Arrow column of the lists that are packed."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """A rank file's content (under one MB) and the public pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids array<int>) of every row of docs; a null or empty text has no ids.  Repeated rows are kept."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(vocabulary(path))
    kind, out = docs.schema[id_col].dataType.simpleString(), [id_col, "ids"]
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    whole = F.length("t") <= chunk + overlap
    form = f"id {kind}, ids array<int>"

    def plain(batches):
        codec = _codec(*held.value)
        for b in batches:
            ids = lists([codec.packed(codec.pieces(t)) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["id", "ids"])

    short = df.where(whole).mapInArrow(plain, form)
    long = df.where(~whole)
    keyed = long.withColumn("key", F.sha2("t", 256))
    texts = keyed.select("key", "t").distinct()
    parts = texts.select("key", "t", F.explode(F.sequence(F.lit(0), F.ceil((F.length("t") - overlap) / chunk).cast("int") - 1)).alias("no"))
    parts = parts.select("key", "no", F.col("t").substr(F.col("no") * chunk + 1, F.lit(chunk + overlap)).alias("t")).repartition(partitions(spark), "key", "no")

    def bounds(batches):
        codec = _codec(*held.value)
        for b in batches:
            found = [edges(codec, t, overlap) for t in b.column(2).to_pylist()]
            both = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *both], names=["key", "no", "t", "head", "tail"])

    seen = parts.mapInArrow(bounds, "key string, no int, t string, head array<int>, tail array<int>")
    by = Window.partitionBy("key").orderBy("no")
    before = F.transform(F.lag("tail").over(by), lambda x: x - chunk)
    seen = seen.withColumn("cut", F.when(F.col("no") == 0, 0).otherwise(F.array_min(F.array_intersect(before, "head"))))
    seen = seen.withColumn("stop", F.lead("cut").over(by) + chunk).withColumn("broken", F.max(F.col("cut").isNull()).over(Window.partitionBy("key")))

    def inner(batches):
        codec = _codec(*held.value)
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(2, 5)), strict=True)
            ids = lists([encode_from(codec, t, a, z) for t, a, z in rows])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids], names=["key", "no", "ids"])

    cut = seen.where("not broken").select("key", "no", "t", "cut", "stop").mapInArrow(inner, "key string, no int, ids array<int>")
    stitched = cut.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    runs = texts.join(seen.where("broken").select("key").distinct(), "key").select("key", "t").mapInArrow(plain_keyed(plain), "key string, ids array<int>")
    return short.union(keyed.select("id", "key").join(stitched.union(runs), "key").select("id", "ids")).toDF(*out)


def plain_keyed(plain):
    def run(batches):
        for b in plain(batches):
            yield b.rename_columns(["key", "ids"])

    return run


def digested(tokens: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of rows (id, ids): decodes the ids and digests both."""
    held = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(*held.value)
        for b in batches:
            column = b.column(1)
            ends, ids = column.offsets.to_numpy().tolist(), column.values.to_numpy()
            rows = []
            for a, z in zip(ends, ends[1:], strict=False):
                i = ids[a:z].tolist()
                rows.append((len(i), hashlib.sha256(codec.joined(i).encode()).hexdigest(), hashlib.sha256(codec.decode(i)).hexdigest()))
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return tokens.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and digest of what they decode to; odd rows as in `encoded`."""
    return digested(encoded(documents(spark, sf_dir)))
