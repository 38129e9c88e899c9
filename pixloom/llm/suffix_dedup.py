"""Removal of repeated byte strings by a partitioned suffix array.

A suffix counts by its first LENGTH bytes (a window).  Sorting all suffixes would
move every byte LENGTH times, so only those that can be repeated are sorted:

0. Texts that equal an earlier text lose all and are set aside by digest.
1. Anchors.  In every window the position whose K bytes have the least hash is
   its anchor; equal windows have the same anchor, and neighbouring windows share
   theirs, so there is about one anchor in (LENGTH - K) / 2 bytes.
2. Anchors whose K-byte hash occurs once in the corpus are dropped: none of their
   windows is repeated.
3. Each remaining anchor brings the bytes of its windows (a context).  Sampled
   splitters range-partition contexts by the leading tokens (8 bytes) of the
   suffix at the anchor; equal contexts collapse before the shuffle and again
   after it, keeping the first place.
4. Each bucket sorts the suffixes of its contexts locally by multikey quicksort
   on 8-byte tokens.  Neighbours that agree on LENGTH bytes form runs; all of a
   run but the first place in the corpus is removed.  A range ends between
   different leading tokens, so no run crosses into the next bucket; a range that
   one leading token overfills is dealt out by further bytes, see `_parts`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, grouped, partitions, small_batches

#: Bytes of a string that counts as repeated, and of what an anchor is chosen by.
LENGTH, K = 100, 32
#: Documents sampled for splitters and hot anchors; the bound doesn't grow with the input.
SAMPLE = 2_000
#: Occurrences of an anchor above which its windows are dealt out by ranges of their offsets, and one by one.
HOT, HUGE = 4096, 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of the k bytes (a power of two) from each position where there are k."""
    h, f, size = data.astype(np.uint64) + np.uint64(1), FACTOR, 1
    while size < k:
        h = h[:-size] * f + h[size:]
        f, size = f * f, 2 * size
    return _mix(h)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        key, size = np.minimum(key[:-size], key[size:]), 2 * size
    return np.minimum(key[: len(key) - (width - size)], key[width - size :]) if width > size else key


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K):
    """(anchor, first window, last window, hash) over texts that lie in data one after another, each to its end.

    Windows lie inside one text; first and last are the starts of the windows that share the anchor.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = gram_hashes(data, k)
    bits = np.uint64(32)  # whatever the data's length, so that equal windows choose alike
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
    at = (_least(key, length - k + 1) & mask).astype(np.int64)
    starts = np.arange(len(at))
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[text]
    starts, at, text = starts[inside], at[inside], text[inside]
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    new = np.nonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])[0]
    last = np.r_[new[1:] - 1, len(starts) - 1]
    return at[new], starts[new], starts[last], h[at[new]]


def _laid(texts: list[bytes | None]):
    """The texts' bytes one after another, and where each ends."""
    texts = [t or b"" for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def _groups(texts: list, most: int = 4 << 20):
    """Ranges of texts of at most `most` bytes together (or one text)."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or b"")
        if k > at and size + n > most:
            yield at, k
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def word_tokens(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number that sorts like them; past the end are zeros."""
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def suffix_runs(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes at starts by their first length bytes.

    Returns (order, run): indices into starts in sorted order, and the run of
    each, equal for equal strings.  Level by level, only suffixes that still tie
    are sorted by their next 8-byte token; alone ones are dropped from the result.
    """
    token, order = word_tokens(data), np.arange(len(starts))
    run = np.zeros(len(starts), np.int64)
    for depth in range(0, length, 8):
        key = token[starts[order] + depth]
        if length - depth < 8:
            key = key >> np.uint64(8 * (8 - length + depth))
        by = np.lexsort((key, run))
        order, key, run = order[by], key[by], run[by]
        new = np.r_[True, (run[1:] != run[:-1]) | (key[1:] != key[:-1])] if len(order) else np.zeros(0, bool)
        run = np.cumsum(new)
        tied = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
        order, run = order[tied], run[tied]
        if not len(order):
            break
    return order, run


def _parts(low: int, high: int, count: int, span: int = LENGTH - K + 1):
    """Ranges of the offsets low..high (bytes of a window before its anchor) that an anchor with count places is dealt out by.

    Windows of one range share the bytes that all of them have, so these can say
    where a range goes: the more often an anchor occurs, the more bytes say it.
    """
    if count <= HOT:
        return [(low, high)]
    size = -(-span // 4) if count <= HUGE else 1
    return [(max(low, a), min(high, a + size - 1)) for a in range(0, span, size) if a <= high and a + size > low]


def contexts(text: bytes, flagged: list[tuple[int, int]], length: int = LENGTH, k: int = K):
    """(first window, lead, anchor's offset, bytes) for the flagged anchors (ordinal, count) of a text."""
    data = np.frombuffer(text, np.uint8)
    at, first, last, _ = anchors(data, np.array([len(data)]), length, k)
    size = -(-(length - k + 1) // 4)
    for no, count in flagged:
        a, f, z = int(at[no]), int(first[no]), int(last[no])
        for low, high in _parts(a - z, a - f, count):
            begin, end = a - high, a - low + length
            if count <= HOT:
                lead = int.from_bytes(text[a : a + 8], "big")
            else:
                step = size if count <= HUGE else 1
                lo = low - low % step
                hi = lo + step - 1
                same = text[a - lo : a + length - hi] + bytes([lo])
                lead = int.from_bytes(hashlib.blake2b(same, digest_size=8).digest(), "big")
            yield begin, lead, a - begin, text[begin:end]


def repeats(found: list[bytes], places: list[tuple], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(context, from, to): offsets of windows of contexts whose string a context has at an earlier place.

    A place is (document, key, start of the context); windows at one place (repeated rows) don't remove each other.
    """
    data, ends = _laid(found)
    begin = np.r_[0, ends[:-1]].astype(np.int64)
    count = np.maximum(0, ends - begin - length + 1)
    owner = np.repeat(np.arange(len(found)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    order, run = suffix_runs(data, begin[owner] + offset, length)
    if not len(order):
        return []
    who, off = owner[order], offset[order]
    texts = {d: i for i, d in enumerate(sorted({p[:2] for p in places}))}
    text = np.array([texts[p[:2]] for p in places])[who]
    start = np.array([p[2] for p in places])[who] + off
    by = np.lexsort((start, text, run))
    who, off, run, text, start = who[by], off[by], run[by], text[by], start[by]
    head = np.nonzero(np.r_[True, run[1:] != run[:-1]])[0]
    top = np.repeat(head, np.diff(np.r_[head, len(run)]))
    later = (text != text[top]) | (start != start[top])
    who, off = who[later], off[later]
    by = np.lexsort((off, who))
    who, off = who[by], off[by]
    if not len(who):
        return []
    new = np.nonzero(np.r_[True, (who[1:] != who[:-1]) | (off[1:] != off[:-1] + 1)])[0]
    last = np.r_[new[1:] - 1, len(who) - 1]
    return list(zip(who[new].tolist(), off[new].tolist(), off[last].tolist(), strict=True))


def bucket_removals(rows: list[tuple], length: int = LENGTH, k: int = K):
    """(doc, key, first window, last window) to remove, from rows (lead, anchor's offset, context, doc, key, start) of whole leads.

    Equal contexts collapse: all but the first lose all their windows.  Then
    anchors with one distinct context are done, and the suffixes of the others
    are sorted.
    """
    firsts: dict[tuple, tuple] = {}
    for lead, off, text, doc, key, start in rows:
        place, at = (doc, key, start), (lead, off, text)
        held = firsts.get(at)
        if held is None or place < held:
            if held is not None:
                yield held[0], held[1], held[2], held[2] + len(text) - length
            firsts[at] = place
        elif place != held:
            yield doc, key, start, start + len(text) - length
    groups: dict[tuple, list] = {}
    for at in firsts:
        groups.setdefault((at[0], at[2][at[1] : at[1] + k]), []).append(at)
    some = [at for g in groups.values() if len(g) > 1 for at in g]
    if some:
        places = [firsts[at] for at in some]
        for who, a, z in repeats([at[2] for at in some], places, length):
            doc, key, start = places[who]
            yield doc, key, start + a, start + z


def spans(windows: list[dict] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed runs (from, to) for ranges of removed windows."""
    out: list[tuple[int, int]] = []
    for a, z in sorted((w["a"], w["z"] + length) for w in windows or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def left(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, z in removed:
        parts.append(text[at:a])
        at = z
    return b"".join([*parts, text[at:]])


def hot_anchors(some: DataFrame, every_nth: int, seen: int = 8, least: int = HOT) -> dict[int, int]:
    """Anchors' hashes that a sample of texts shows to be hot, each with the places it has by the sample.

    Each occurs `seen` times in the sample's different texts, so it is repeated
    and need not be counted: its places skip the task that would count them.  A
    hash that the sample doesn't show is counted; results are the same.
    """

    def hashes(batches):
        for b in batches:
            for text in b.column("text").cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(anchors(*_laid([text]))[3].view(np.int64))], names=["h"])

    counts = some.dropDuplicates(["text"]).mapInArrow(hashes, "h long").groupBy("h").agg((F.count("*") * every_nth).alias("n"))
    return {r.h: r.n for r in counts.where((F.col("n") >= seen * every_nth) & (F.col("n") > least)).collect()}


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc, text, rest: docs' other columns) and `windows`: ranges (a, z) of repeated windows' starts, null if there is none.

    A window is repeated if it also starts earlier: in a smaller id, or earlier
    in the same text.  Null ids come first.  Rows with an equal id and an equal
    text are one document and lose the same bytes; rows with an equal id and
    different texts are ordered by a hash of the text.  Null texts are empty.
    Ids are integers; other columns ride along in `rest`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    if docs.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError("ids must be integers: their order says which of equal strings stays")
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("u")).first()
    plain = ids.n == ids.u
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.col(id_col).cast("long")
    key = F.coalesce(doc, F.lit(0)) if plain else F.xxhash64(id_col, text)
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    base = docs.select(key.alias("key"), doc.alias("doc"), text.alias("text"), rest.alias("rest"))
    # whole copies of an earlier text lose every window; the sort needn't see them
    digest = base.select("key", "doc", F.md5("text").alias("m"))
    least = F.min(F.struct("doc", "key")).alias("f"), F.count("*").alias("n")
    every = grouped(digest, "m", ["doc", "key"], [*least], [F.min("f").alias("f"), F.sum("n").alias("n")], "n > 1")
    copies = every.where("not (doc <=> f.doc and key <=> f.key)").select("key", F.lit(True).alias("copy")).distinct()
    held = base.repartition(n, "key").join(copies.hint("shuffle_hash"), "key", "left")
    rest_of = held.where("copy is null")

    def find(batches):
        for b in batches:
            texts, keys = b.column("text").cast(pa.binary()).to_pylist(), b.column("key").to_numpy()
            for lo, hi in _groups(texts):
                data, ends = _laid(texts[lo:hi])
                at, _, _, h = anchors(data, ends)
                own = np.searchsorted(ends, at, side="right")
                first = np.searchsorted(own, np.arange(hi - lo))
                h, no = h.view(np.int64), (np.arange(len(at)) - first[own]).astype(np.int32)
                known = [hot.get(x) for x in h.tolist()]
                salt = np.where([c is None for c in known], 0, (keys[lo:hi][own] + no) % n)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(keys[lo:hi][own]), pa.array(no), pa.array(salt.astype(np.int32)), pa.array(known, pa.int64())], names=["h", "key", "no", "salt", "known"])

    tokens_of = lambda b: [int.from_bytes(t[a : a + 8], "big") for t in b.column("text").cast(pa.binary()).to_pylist() for a in anchors(*_laid([t]))[0].tolist()[::8]]

    def leads(batches):
        for b in batches:
            got = np.array(tokens_of(b), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((got ^ np.uint64(1 << 63)).view(np.int64))], names=["lead"])

    every_nth = max(1, ids.n // SAMPLE)
    some = base.where(F.pmod(F.xxhash64("key"), F.lit(every_nth)) == 0).select("text")
    cuts = some.mapInArrow(leads, "lead long").agg(F.percentile_approx("lead", [k / n for k in range(1, n)] or [0.5], 10_000).alias("c")).first().c or []
    splitters = np.array(sorted(set(cuts)), np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    hot = hot_anchors(some, every_nth)
    found = rest_of.mapInArrow(find, "h long, key long, no int, salt int, known long").repartition(n, "h", "salt")
    counted = found.withColumn("n", F.coalesce("known", F.count("*").over(Window.partitionBy("h", "salt")))).where("n > 1")
    flagged = counted.groupBy("key").agg(F.collect_list(F.struct("no", F.least("n", F.lit(HUGE + 1)).cast("int").alias("n"))).alias("flagged"))

    def bring(batches):
        known: dict[tuple, tuple] = {}  # contexts that this task has sent, by their first places
        for b in batches:
            rows = []
            for key, doc, text, _, flags in zip(*(b.column(c).to_pylist() for c in ("key", "doc", "text", "rest_", "flagged")), strict=True):
                doc = -(1 << 63) if doc is None else doc
                for begin, lead, off, part in contexts(text.encode(), [(f["no"], f["n"]) for f in flags]):
                    place, at = (doc, key, begin), (lead, off, part)
                    earlier = known.get(at)
                    if earlier is not None and earlier < place:
                        rows.append((hash(place) % n, 0, -1, len(part).to_bytes(4, "big"), *place))  # removed already; goes anywhere
                        continue
                    known[at] = place
                    rows.append((min(n - 1, int(np.searchsorted(splitters, np.uint64(lead), side="right"))) if len(splitters) else 0, lead - (1 << 63), off, part, *place))
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "lead", "off", "part", "doc", "key", "start"])

    # the same columns as everywhere else, so that one exchange of the documents serves all
    near = rest_of.join(flagged.hint("shuffle_hash"), "key").select("key", "doc", "text", F.hash("rest").alias("rest_"), "flagged").sortWithinPartitions("doc", "key")  # in order, so that a repeated task sends the same rows
    sent = near.mapInArrow(bring, "bucket int, lead long, off int, part binary, doc long, key long, start int")
    sorted_ = sent.repartitionById(n, "bucket").sortWithinPartitions("lead")

    def settle(batches):
        def out(rows):
            gone = list(bucket_removals(rows))
            columns = zip(*[(k, a, z) for _, k, a, z in gone], strict=True) if gone else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "a", "z"])

        rows, size = [], 0
        for b in batches:
            done = []
            for lead, off, part, doc, key, start in zip(*(b.column(c).to_pylist() for c in ("lead", "off", "part", "doc", "key", "start")), strict=True):
                if off < 0:
                    done.append((key, start, start + int.from_bytes(part, "big") - LENGTH))
                    continue
                if size > 2 << 20 and lead != rows[-1][0]:
                    yield out(rows)
                    rows, size = [], 0
                rows.append((lead, off, part, doc, key, start))
                size += len(part)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "a", "z"])
        yield out(rows)

    gone = sorted_.mapInArrow(settle, "key long, a int, z int")
    windows = gone.groupBy("key").agg(F.collect_list(F.struct("a", "z")).alias("windows"))
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.octet_length("text") - LENGTH).alias("z")))
    none = F.lit(None).cast("array<struct<a:int,z:int>>")
    told = F.when(F.col("copy").isNull(), F.col("windows")).otherwise(F.when(F.octet_length("text") >= LENGTH, whole).otherwise(none))
    return held.join(windows.hint("shuffle_hash"), "key", "left").select("key", "doc", "text", "rest", told.alias("windows"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) of every row of docs; see `repeated` for what counts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for text, windows in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("windows").to_pylist(), strict=True):
                cut = spans(windows)
                rows.append((len(text), sum(z - a for a, z in cut), len(cut), left(text, cut)))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("rest").field(id_col), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return repeated(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated strings cut out of text; a character of which a cut leaves a part is dropped whole."""

    def run(batches):
        for b in batches:
            kept = [left(t, spans(w)).decode("utf-8", "ignore") for t, w in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("windows").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), b.column("rest")], names=["text", "rest"])

    kind = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("rest")).schema["rest"].dataType.simpleString()
    got = repeated(docs, id_col, text_col).mapInArrow(run, f"text string, rest {kind}")
    return got.select(*(F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))


def op5_suffix(spark, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and runs, and digest of what is left of every document; odd rows as in `repeated`."""
    return removed(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS k FROM texts),
ranked AS (SELECT doc_id, k, row_number() OVER (PARTITION BY array_slice(b, k, k + {LENGTH - 1}) ORDER BY doc_id, k) AS nth FROM places),
gone AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + {LENGTH} THEN 0 ELSE 1 END AS starts FROM ranked WHERE nth > 1),
runs AS (SELECT doc_id, k, sum(starts) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM gone),
cuts AS (
    SELECT doc_id, min(k) AS a, max(k) + {LENGTH} AS z FROM runs GROUP BY doc_id, run
    UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) + 1 FROM texts
),
pieces AS (SELECT doc_id, a, z, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a, z) AS f FROM cuts)
SELECT doc_id, any_value(octet_length(b))::BIGINT AS n_bytes, sum(z - a)::BIGINT AS n_removed, count(*) FILTER (z > a)::BIGINT AS n_spans,
    sha256(unhex(string_agg(CASE WHEN a > f THEN hex(array_slice(b, f, a - 1)) ELSE '' END, '' ORDER BY a, z))) AS kept_sha256
FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id
"""
