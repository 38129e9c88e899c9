"""Runs: stretches of words that repeat with a period, by Main and Lorentz's divide and conquer.

Words are interned to numbers.  A segment is cut at its middle; Z-functions of
the two halves, of the left one reversed and of each half in the whole tell for
every period how far words agree on both sides of the cut, so all repetitions
that cross it are found at once, and both halves follow.  A repetition that goes
on beyond its segment crosses a cut of a wider one, which has reported it whole.
An interval keeps its smallest period.

A run of L words or more agrees with itself, shifted by its period, over at least
half of L words, so all its words lie in sequences of that many words that the
text holds twice.  Only stretches of such sequences are searched; in prose
without repetitions there are none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

#: Words of a run at least (and twice its period).
LEAST = 12
WORD = r"[^\x20\x09-\x0D]+"
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def z_lengths(s: np.ndarray) -> np.ndarray:
    """How many of the first words the words from each place on agree with; only places with the first word are looked at."""
    out = np.zeros(len(s), np.int64)
    places = (np.flatnonzero(s[1:] == s[0]) + 1).tolist() if len(s) else []
    if not places:
        return out
    words, n, z, left, right = s.tolist(), len(s), {}, 0, 0
    for i in places:
        k = min(z.get(i - left, 0), right - i) if i < right else 1
        if i + k >= right:
            while i + k < n and words[k] == words[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    out[places] = [z[i] for i in places]
    return out


def _within(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How many of pattern's first words the words of text from each place on agree with."""
    return z_lengths(np.concatenate([pattern, [-1], text]))[len(pattern) + 1 :]


def _crossing(s: np.ndarray, lo: int, mid: int, hi: int, least: int):
    """(start, end, period) arrays of the repetitions in s[lo:hi] that have words on both sides of mid."""
    right, left = s[mid:hi], s[lo:mid][::-1]
    found = []
    # the period's repeat lies right of mid: the word before mid comes again p words on
    p = np.flatnonzero(right == left[0]) + 1
    if len(p):
        back = _within(left, np.concatenate([right[::-1], left]))[len(right) - p]
        ahead = np.append(z_lengths(right), 0)[p]
        found.append((mid - back, mid + p + ahead, p))
    # or left of it: the word after mid stands p words before, too
    p = np.flatnonzero(left == right[0]) + 1
    if len(p):
        ahead = _within(right, s[lo:hi])[len(left) - p]
        back = np.append(z_lengths(left), 0)[p]
        found.append((mid - p - back, mid + ahead, p))
    for start, end, p in found:
        fits = end - start >= np.maximum(least, 2 * p)
        yield from zip(start[fits].tolist(), end[fits].tolist(), p[fits].tolist(), strict=True)


def _stretches(s: np.ndarray, words: int) -> list[tuple[int, int]]:
    """(start, end) of what sequences of so many words that occur twice in s cover."""
    n = len(s) - words + 1
    mixed = s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = np.zeros(n, np.uint64)
    for k in range(words):  # equal sequences have equal keys; unequal ones with equal keys only cost time
        key = key * np.uint64(0x100000001B3) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(s) + 1, np.int64)
    np.add.at(change, np.flatnonzero(twice), 1)
    np.add.at(change, np.flatnonzero(twice) + words, -1)
    inside = np.r_[0, np.cumsum(change)[:-1] > 0, 0].astype(np.int8)
    edge = np.diff(inside)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def runs_of(s: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of numbers >= 0, by start, then period."""
    if least < 2:
        raise ValueError("a run has two words at least")
    n, best = len(s), {}
    if n < least:
        return []
    todo = [x for x in _stretches(s, (least + 1) // 2) if x[1] - x[0] >= least]
    while todo:
        lo, hi = todo.pop()
        mid = (lo + hi) // 2
        for start, end, p in _crossing(s, lo, mid, hi, least):
            if start == lo and lo and s[lo - 1] == s[lo - 1 + p] or end == hi and hi < n and s[hi] == s[hi - p]:
                continue  # a part of what a wider segment has reported
            best[start, end] = min(p, best.get((start, end), p))
        todo += [x for x in ((lo, mid), (mid, hi)) if x[1] - x[0] >= least]
    return sorted(((a, b - a, p) for (a, b), p in best.items()), key=lambda r: (r[0], r[2]))


def interned(words: list[bytes]) -> np.ndarray:
    """The place of each word's first occurrence."""
    index: dict[bytes, int] = {}
    return np.fromiter(map(index.setdefault, words, range(len(words))), np.int64, len(words))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row of docs: its runs by start, then period, and its text with each run cut to its first period.

    Words are what ASCII white space parts, as they stand.  A null, empty or
    white text has no words, no runs and an empty collapsed text.  Words of
    collapsed are joined by one space.  Ids may be null, repeat and be of any
    type; every row gives one row; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    form = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        for b in batches:
            count, found, rest = [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                runs = runs_of(interned(words), least)
                count.append(len(words))
                found.append([{"start": a, "length": n, "period": p} for a, n, p in runs])
                rest.append(b" ".join([words[k] for k in np.flatnonzero(kept_words(len(words), runs))] if runs else words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(found, form), pa.array(rest, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs {RUN}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the texts, chosen by their id, goes on periodically from some word."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    placed = chosen.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> words[if(i < a, i, a + (i - a) % p)]), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op11_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them made periodic by rule: count, the longest, and digests of all runs and of the collapsed text; odd rows as in `periodic_runs`.

    A document without an id stays as it is.
    """
    found = periodic_runs(planted(documents(spark, sf_dir)))
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'first', -r.start, 'small', -r.period)))")
    every = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.first"), F.col("best.length"), -F.col("best.small")
    milli = F.expr("1000 * best.length div -best.small")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


# CRC-32 of a decimal number by bits; words by pattern; equal six-word sequences p apart, as islands of starts, are all that runs can be
OP11_SQL = r"""
with hashed as (
  select doc_id, text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint) as h from documents),
split as (select row_number() over () as doc, doc_id, h, h // 10 as g, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from hashed),
cut as (select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then g % len(w) end as a from split),
period as (select *, 1 + (n - a) // (3 + g % 8) as p from cut),
made as materialized (select doc, doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) end as w from period),
words as materialized (select doc, unnest(w) as word, unnest(range(n)) as i from made where n >= 12),
grams as materialized (select doc, i, hash(word, lead(word, 1) over t, lead(word, 2) over t, lead(word, 3) over t, lead(word, 4) over t, lead(word, 5) over t) as k,
  [word, lead(word, 1) over t, lead(word, 2) over t, lead(word, 3) over t, lead(word, 4) over t, lead(word, 5) over t] as six, lead(i, 5) over t as last from words window t as (partition by doc order by i)),
pairs as (select x.doc, x.i, y.i - x.i as q from grams x join grams y on x.doc = y.doc and x.k = y.k and x.six = y.six and x.i < y.i where x.last is not null and y.last is not null),
islands as (select doc, q, min(i) as start, count(*) + 5 + q as length from (select *, i - row_number() over (partition by doc, q order by i) as island from pairs) group by doc, q, island),
runs as materialized (select doc, start, length, min(q) as period from islands where length >= greatest(12, 2 * q) group by doc, start, length),
told as (select doc, count(*) as n_runs, min({'l': -length, 's': start, 'p': period}) as best, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as text from runs group by doc),
gone as (select distinct doc, unnest(range(start + period, start + length)) as i from runs),
rest as (select doc, string_agg(word, ' ' order by i) as text from words where doc in (select doc from runs) and (doc, i) not in (select (doc, i) from gone) group by doc)
select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, -best.l as length, best.p as period, 1000 * -best.l // best.p as exponent_milli,
  sha256(coalesce(told.text, '')) as runs_sha256, sha256(coalesce(case when told.doc is null then array_to_string(w, ' ') else rest.text end, '')) as collapsed_sha256
from made left join told using (doc) left join rest using (doc)"""
