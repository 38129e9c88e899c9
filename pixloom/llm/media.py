"""Media columns: chroma audio fingerprints, and recordings aligned by them.

Sound becomes frames of energy by pitch class.  An integral image over the frames
gives any rectangle's sum in four look-ups; sixteen filters compare rectangles,
each is quantised to two bits, and a frame's bits pack into one 32-bit integer.
Two recordings align where the histogram of offsets between equal integers
peaks; the bit error over the overlap at that offset says whether they match.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, written

#: Samples of a frame and between frames at BASE samples a second; at other rates frames last as long.
BASE, FRAME, HOP = 4000, 2048, 512
#: Frequencies that count, in Hz, and the A that pitch classes are counted from.
LOW, HIGH, A = 60.0, 1800.0, 440.0
#: A filter: kind, first pitch class, pitch classes, frames.  By rule: the widest first, each kind over the octave's parts.
FILTERS = tuple((k % 4, (5 * k) % 12 % (12 - h + 1), h, w) for k, (h, w) in enumerate((h, w) for w in (14, 10, 6, 2) for h in (4, 6, 3, 8)))
WIDTH = max(f[3] for f in FILTERS)
#: A filter's value below, between and above these has Gray codes 0, 1, 3 and 2.
BOUNDS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Least equal integers at one offset, least frames of overlap, most share of differing bits of a match.
VOTES, OVERLAP, ERRORS = 3, 12, 0.2
#: Most recordings and bytes of one block of queries and of one block of rows (expected: a hash deals them), and least blocks of rows.
QUERY_BLOCK, ROW_BLOCK, BLOCK_BYTES, LEAST_BLOCKS = 1024, 4096, 16 << 20, 32
#: The integer of silence, which says nothing about an offset; and equal integers paired at a time.
SILENCE, PAIRS = 0xFFFFFFFF, 1 << 21


def pcm(wav: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a 16-bit PCM WAV file; empty for null, empty or other content."""
    none = np.zeros(0), 8000
    if not wav or wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        return none
    at, form = 12, None
    while at + 8 <= len(wav):
        name, size = wav[at : at + 4], struct.unpack("<I", wav[at + 4 : at + 8])[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack("<HHIIHH", wav[at + 8 : at + 24])
        elif name == b"data" and form:
            if form[0] != 1 or form[5] != 16 or not form[1]:
                return none
            data = wav[at + 8 : at + 8 + size]
            x = np.frombuffer(data[: len(data) // (2 * form[1]) * 2 * form[1]], "<i2").reshape(-1, form[1])
            return x.mean(axis=1) / 32768, form[2]
        at += 8 + size + size % 2
    return none


def wav(samples: np.ndarray, rate: int) -> bytes:
    data = np.clip(np.round(samples * 32767), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12): share of each pitch class in a frame's energy; silent frames are zero."""
    frame, hop = round(FRAME * rate / BASE), HOP * rate / BASE
    n = int((len(samples) - frame) // hop) + 1
    if n < 1 or frame < 2:
        return np.zeros((0, 12))
    freq = np.fft.rfftfreq(frame, 1 / rate)
    use = np.nonzero((freq >= LOW) & (freq <= HIGH))[0]
    pitch = np.round(12 * np.log2(freq[use] / A)).astype(int) % 12
    to = np.zeros((len(use), 12))
    to[np.arange(len(use)), pitch] = 1
    out = np.zeros((n, 12))
    begin = np.floor(np.arange(n) * hop + 1e-6).astype(np.int64)
    windows, step = np.lib.stride_tricks.sliding_window_view(samples, frame), max(1, (512 * FRAME) // frame)
    for at in range(0, n, step):  # bounded memory for long recordings
        rows = windows[begin[at : at + step]] * np.hanning(frame)
        out[at : at + step] = (np.abs(np.fft.rfft(rows, axis=1)[:, use]) ** 2) @ to
    out *= (FRAME / frame) ** 2
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 1e-6, out / np.maximum(total, 1e-6), 0)


def integers(image: np.ndarray) -> np.ndarray:
    """The packed integer of each frame that WIDTH frames begin at."""
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    area = np.zeros((len(image) + 1, 13))
    area[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def box(t0, t1, y0, y1):
        return area[at + t1, y1] - area[at + t0, y1] - area[at + t1, y0] + area[at + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        whole, mid_t, mid_y = box(0, w, y, y + h), w // 2, y + h // 2
        if kind == 0:  # later against earlier
            a = box(mid_t, w, y, y + h)
        elif kind == 1:  # upper against lower pitches
            a = box(0, w, mid_y, y + h)
        elif kind == 2:  # diagonal quarters
            a = box(0, mid_t, y, mid_y) + box(mid_t, w, mid_y, y + h)
        else:  # the middle pitches against those around
            a = box(0, w, y + h // 3, y + h - h // 3)
        value = np.log1p(a) - np.log1p(whole - a)
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(BOUNDS, value, side="right")]
    return out


def fingerprint(audio: bytes | None) -> np.ndarray:
    return integers(chroma(*pcm(audio)))


def _votes(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts."""
    key, back = np.unique(key, return_inverse=True)
    return key, np.bincount(back, count, minlength=len(key)).astype(np.int64)


def align(a: list[np.ndarray], b: list[np.ndarray], skip=None) -> list[tuple[int, int, int, int, int, int]]:
    """(i, j, offset, votes, overlap, bit errors) of fingerprints a[i], b[j] that match; offset is a's frame at b's first.

    Recordings of a go in groups of about PAIRS equal integers, and a group's
    histogram is added up PAIRS at a time.
    """
    whole_b = np.concatenate([*b, np.zeros(0, np.uint32)])
    start_b, own_b = np.cumsum([0, *map(len, b)])[:-1], np.repeat(np.arange(len(b)), [len(v) for v in b])
    order = np.argsort(whole_b, kind="stable")
    values = whole_b[order]
    low = [np.searchsorted(values, x, "left") for x in a]
    many = [np.where(x == SILENCE, 0, np.searchsorted(values, x, "right") - lo) for x, lo in zip(a, low, strict=True)]
    back = max(map(len, b), default=0)  # offsets begin at -back
    span = back + max(map(len, a), default=0) + 1
    out, i = [], 0
    while i < len(a):
        first, size = i, 0
        while i < len(a) and (i == first or size + many[i].sum() <= PAIRS):
            size += int(many[i].sum())
            i += 1
        group = range(first, i)
        own, at = np.repeat(np.array(group), [len(a[k]) for k in group]), np.concatenate([np.arange(len(a[k])) for k in group])
        n, lo = np.concatenate([many[k] for k in group]), np.concatenate([low[k] for k in group])
        ends = np.cumsum(n)
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for p in range(0, size, PAIRS):
            pair = np.arange(p, min(size, p + PAIRS))
            row = np.searchsorted(ends, pair, side="right")
            other = order[lo[row] + pair - (ends[row] - n[row])]
            offset = at[row] - (other - start_b[own_b[other]]) + back
            found = _votes((own[row] * len(b) + own_b[other]) * span + offset, np.ones(len(pair)))
            key, count = _votes(np.concatenate([key, found[0]]), np.concatenate([count, found[1]]))
        both = key // span
        best = np.lexsort((key, -count, both))
        best = best[np.r_[True, both[best][1:] != both[best][:-1]]] if len(best) else best
        for k in best[count[best] >= VOTES].tolist():
            x, y, offset = int(both[k] // len(b)), int(both[k] % len(b)), int(key[k] % span - back)
            if skip and skip(x, y):
                continue
            u, v = a[x][max(0, offset) :], b[y][max(0, -offset) :]
            n_both = min(len(u), len(v))
            errors = int(np.bitwise_count(u[:n_both] ^ v[:n_both]).sum())
            if n_both >= OVERLAP and errors <= ERRORS * 32 * n_both:
                out.append((x, y, offset, int(count[k]), n_both, errors))
    return out


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """(id, print binary: little-endian 32-bit integers) of every row; null, short or foreign audio has none."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [fingerprint(x).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=[id_col, "print"])

    return media.select(id_col, audio_col).mapInArrow(run, f"`{id_col}` {kind}, print binary")


def matched(prints: DataFrame, id_col: str, queries) -> DataFrame:
    """One row a recording: id, class_id, n_frames, print, is_query, n_links, match_id, offset, overlap, bit_errors.

    Recordings with an equal fingerprint are a class, named by its smallest id.
    The recordings that `queries` (a Column) holds for are searched for, class by
    class and block by block, among all classes; n_links counts the other classes
    that match and match_id is the one with the least share of bit errors (ties:
    the smaller id).  Empty fingerprints match nothing, and silence has no say
    in offsets.  Repeated rows and rows without an id are kept; ids are integers.
    """
    spark = prints.sparkSession
    prints = written(prints, "prints")
    classes = prints.where(F.length("print") > 0).groupBy("print").agg(F.min(id_col).alias("class_id"), F.max(F.coalesce(queries, F.lit(False))).alias("asked")).where("class_id is not null")
    classes = written(classes, "classes")
    length = F.length("print")
    size = classes.agg(F.count("*").alias("n"), F.count_if("asked").alias("q"), F.sum(length).alias("bytes"), F.sum(F.when(F.col("asked"), length)).alias("q_bytes")).first()
    n_rows = max(LEAST_BLOCKS, -(-size.n // ROW_BLOCK), -(-(size.bytes or 0) // BLOCK_BYTES))
    n_queries = max(1, -(-size.q // QUERY_BLOCK), -(-(size.q_bytes or 0) // BLOCK_BYTES))

    def pack(table):
        fps = table.column("print").to_pylist()
        one = [table.column("block")[:1].combine_chunks(), pa.array([table.column("class_id").to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([np.array([len(p) for p in fps], np.int64).tobytes()], pa.binary()), pa.array([b"".join(fps)], pa.binary())]
        return pa.Table.from_arrays(one, names=["block", "ids", "sizes", "prints"])

    def blocks(df, n):
        dealt = df.select("class_id", "print", F.pmod(F.xxhash64("class_id"), F.lit(n)).cast("int").alias("block"))
        return dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, sizes binary, prints binary")

    asked = blocks(classes.where("asked"), n_queries).select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("b"), F.lit(0).alias("side"), "ids", "sizes", "prints")
    rows = blocks(classes, n_rows).select(F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("a"), F.col("block").alias("b"), F.lit(1).alias("side"), "ids", "sizes", "prints")
    form = "query_id long, other_id long, offset int, votes int, overlap int, bit_errors long"

    def compare(table):
        sides = {0: [], 1: []}
        for side, ids, sizes, data in zip(*(table.column(c).to_pylist() for c in ("side", "ids", "sizes", "prints")), strict=True):
            cut = np.cumsum(np.frombuffer(sizes, np.int64) // 4)[:-1]
            sides[side] += list(zip(np.frombuffer(ids, np.int64).tolist(), np.split(np.frombuffer(data, np.uint32), cut), strict=True))
        (ia, fa), (ib, fb) = (([x[0] for x in s], [x[1] for x in s]) for s in (sides[0], sides[1]))
        found = align(fa, fb, lambda i, j: ia[i] == ib[j]) if fa and fb else []
        found = [(ia[i], ib[j], *rest) for i, j, *rest in found]
        columns = zip(*found, strict=True) if found else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "other_id", "offset", "votes", "overlap", "bit_errors"])

    links = asked.union(rows).repartition(partitions(spark), "a", "b").groupBy("a", "b").applyInArrow(compare, form)
    best = F.min_by(F.struct("other_id", "offset", "overlap", "bit_errors"), F.struct(F.col("bit_errors") / F.col("overlap"), F.col("other_id")))
    by = links.groupBy("query_id").agg(F.count("*").alias("n_links"), best.alias("best"))
    of = classes.join(by, F.col("class_id") == F.col("query_id"), "left").select("print", "class_id", "n_links", "best")
    full = prints.join(of, "print", "left").withColumn("is_query", F.coalesce(queries, F.lit(False)))
    told = lambda c: F.when(F.col("is_query"), F.col("best")[c])
    return full.select(
        id_col, F.coalesce("class_id", id_col).alias("class_id"), (F.length("print") / 4).cast("long").alias("n_frames"), "print", "is_query",
        F.when(F.col("is_query"), F.coalesce("n_links", F.lit(0))).alias("n_links"), told("other_id").alias("match_id"), told("offset").alias("offset"), told("overlap").alias("overlap"), told("bit_errors").alias("bit_errors"),
    )


RATE, NOTE = 4000, 384


def melody(vector) -> bytes:
    """A recording for an embedding: a note for each value, its pitch by the value."""
    if vector is None or not len(vector):
        return b""
    pitch = 69 + np.round(24 * np.nan_to_num(np.asarray(vector, float))).clip(-24, 12)
    hz = np.repeat(440 * 2 ** ((pitch - 69) / 12), NOTE)
    return wav(0.5 * np.sin(2 * np.pi * np.cumsum(hz) / RATE), RATE)


def recordings(embeddings: DataFrame) -> DataFrame:
    """(vec_id, audio binary): the tables hold no sound, so every embedding is played."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([melody(v) for v in part.column(1).to_pylist()], pa.binary())], names=["vec_id", "audio"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, audio binary")


def op3_media(spark, sf_dir: str) -> DataFrame:
    """Class, links and best match of every embedding's recording; odd rows as in `matched`."""
    small_batches(spark)
    media = recordings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = matched(fingerprints(media, "vec_id", "audio"), "vec_id", F.col("vec_id") % 20 == 0)
    return found.withColumn("print_sha256", F.sha2("print", 256)).drop("print")
