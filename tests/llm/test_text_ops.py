"""Operators over documents against brute force, on small tables with nulls, ties, repeats and odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from pixloom.llm import bpe, langid, license_scan, mixing, quality, simhash, suffix_dedup
from pixloom.llm.components import components

FORM = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("lo", "ra", "mi", "té", "von", "der") for b in ("n", "st", "ble", "ña", "ing", "x")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def table(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], FORM)
    return df.selectExpr("*", "1 as key", "2 as doc", "'x' as windows", "3 as fingerprint", "4 as w") if extra else df


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    shared, line = prose(rng, 60), "Same line in many texts."
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(0, 60)]
    rows += [(100 + i, rows[i][1]) for i in range(8)]  # exact copies
    rows += [(120 + i, rows[20 + i][1].replace(" ", "  ", 3) + " end") for i in range(8)]  # near copies
    rows += [(140 + i, f"{prose(rng, 10)} {shared} {prose(rng, 5)}\n{line}\n{line}") for i in range(8)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "a" * 900), (204, "Und " * 200), (205, "é" * 130), (206, "ONE!! TWO!! " * 40), (207, " ".join(f"{w}###" for w in WORDS * 3)), (208, prose(rng, 9000))]
    return rows


EMPTY = [simhash.near_duplicates, quality.judged, suffix_dedup.removed, bpe.encoded, license_scan.scanned, langid.identified, simhash.keep_first, quality.keep_good, suffix_dedup.without_repeats]


@pytest.mark.parametrize("op", EMPTY, ids=lambda f: f.__name__)
def test_empty_table_and_clashing_columns(spark, op):
    assert op(table(spark, [])).count() == 0
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, None), (2, ""), (None, "some text of no id")]
    got = op(table(spark, rows, extra=True)).collect()
    # keep_first: one of the repeated rows, one of those without words, one other; keep_good: no text has ten words
    assert len(got) == {"keep_first": 3, "keep_good": 0}.get(op.__name__, 5)


# --- op 1 -----------------------------------------------------------------------


def naive_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_with_a_hub(spark):
    rng = random.Random(4)
    edges = [(0, k) for k in range(1, 400)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1040)]
    edges += [(7, 7), (0, 1), (1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = [e for e in edges if e[0] != e[1]]
    assert got == naive_components({x for e in linked for x in e}, linked)


def test_components_take_few_rounds(spark, monkeypatch):
    """Near copies in six tiles, each pair of tiles linked by a task of its own: a round costs the driver a thousand small tasks."""
    from pixloom.llm import components as module

    rounds, rng = [], random.Random(5)
    monkeypatch.setattr(module, "_stars", lambda edges, f=module._stars: rounds.append(1) or f(edges))
    tiles = [list(range(50 * k, 50 * k + 50)) for k in range(6)]
    walks = [rng.sample(x + y, 100) for k, x in enumerate(tiles) for y in tiles[k + 1 :]]
    edges = [e for w in walks for e in zip(w, w[1:], strict=False)]
    got = components(spark.createDataFrame(spark.sparkContext.parallelize(edges, len(walks)), "a long, b long")).collect()
    assert {r.node: r.component for r in got} == dict.fromkeys(range(300), 0) and len(got) == 300
    assert len(rounds) == 1
    rounds.clear()
    assert components(spark.createDataFrame([(k, 0) for k in range(1, 50)], "a long, b long")).count() == 50
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
    assert not rounds


def naive_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, corpus):
    fp = {i: naive_print(t) for i, t in corpus}
    want = naive_components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    got = simhash.near_duplicates(table(spark, corpus)).collect()
    assert {r.doc_id: r.fingerprint % 2**64 for r in got} == fp
    assert {r.doc_id: r.component_id for r in got} == want
    for kind in ("int", "string", "decimal(9,0)"):
        rows = table(spark, corpus).withColumn("doc_id", F.format_string("%04d", "doc_id") if kind == "string" else F.col("doc_id").cast(kind))
        assert {int(r.doc_id): int(r.component_id) for r in simhash.near_duplicates(rows).collect()} == want, kind


def test_simhash_of_odd_rows(spark):
    text = "one two three four five six"
    rows = table(spark, [(3, text), (3, text), (None, text), (None, "some other text without any id"), (7, None), (None, ""), (9, " ")], extra=True)
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(rows).collect())
    assert got == [(0, 0), (0, 3), (0, 7), (3, 3), (3, 3), (7, 7), (9, 7)]
    kept = simhash.keep_first(rows).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text is not None) == [(0, "some other text without any id"), (3, text)]
    assert [r.doc_id for r in kept if r.text is None] == [7] and kept[0].windows == "x" and len(kept) == 3


@pytest.mark.parametrize("cut", [None, 20])
def test_similar_forest(cut):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1000, (8, 60)).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base[rng.integers(8)])[: rng.integers(40, 60)], rng.integers(0, 1000, rng.integers(0, 5)).astype(np.uint64)])) for _ in range(60)] + [np.zeros(0, np.uint64)] * 2
    i, j = simhash.similar_forest(sets, cut)
    near = [(a, b) for a in range(62) for b in range(a + 1, 62) if (cut is None or a < cut <= b) and (k := len(np.intersect1d(sets[a], sets[b]))) and 5 * k >= 4 * (len(sets[a]) + len(sets[b]) - k)]
    assert near and set(zip(i.tolist(), j.tolist(), strict=True)) <= set(near)
    assert naive_components(range(62), zip(i.tolist(), j.tolist(), strict=True)) == naive_components(range(62), near)


def test_links_over_tiles(spark, monkeypatch):
    """The same components however small the tiles are, for narrow and wide fingerprints."""
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63, (30, 3))
    fp = base[rng.integers(0, 30, 400)] ^ (1 << rng.integers(0, 63, (400, 3)))
    size = rng.integers(90, 130, 400)
    monkeypatch.setattr(simhash, "LEAST_TILE", 25)
    df = spark.createDataFrame([(k, *map(int, f), int(n)) for k, (f, n) in enumerate(zip(fp, size, strict=True))], "node long, w0 long, w1 long, w2 long, size int")
    bits = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None]).sum(axis=2)
    fits = 5 * np.minimum(size[:, None], size) >= 4 * np.maximum(size[:, None], size)
    for radius, table_, near in ((6, df, (bits <= 6) & fits), (5, df.drop("size"), bits <= 5)):
        found = [(r.a, r.b) for r in simhash.links(table_, radius).collect()]
        want = [(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True) if a < b]
        assert naive_components(range(400), found) == naive_components(range(400), want) and all(near[a, b] for a, b in found)


@pytest.mark.parametrize("n, spread", [(3000, 64), (2500, 6)])
def test_link_forest(n, spread):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, n // 10, dtype=np.uint64)
    fp = np.unique(base[rng.integers(0, len(base), n)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, spread, (n, 3)).astype(np.uint64), axis=1))
    cut = len(fp) // 3
    for a, b in ((fp, None), (fp[:cut], fp[cut:])):
        i, j = simhash.link_forest(a[:, None], None if b is None else b[:, None], 4)
        both = fp if b is None else np.concatenate([a, b])
        near = np.bitwise_count(both[:, None] ^ both[None, :]) <= 4
        if b is not None:
            near[:cut, :cut] = near[cut:, cut:] = False
        x, y = np.nonzero(near)
        assert (np.bitwise_count(both[i] ^ both[j]) <= 4).all() and len(i) < len(both)
        ids = range(len(both))
        assert naive_components(ids, zip(i.tolist(), j.tolist(), strict=True)) == naive_components(ids, [(p, q) for p, q in zip(x.tolist(), y.tolist(), strict=True) if p < q])


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7), (100, 101)]
    ids = {x for e in edges for x in e if e[0] != e[1]}
    want = naive_components(ids, [e for e in edges if e[0] != e[1]])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# --- op 2 -----------------------------------------------------------------------


def naive_cost(texts, order, least, text):
    """Code length by context counts in dictionaries, by the definition."""
    data = "\n".join(texts).lower().encode() + b"\n"
    counts = [{} for _ in range(order + 1)]
    for d in range(order + 1):
        for k in range(d, len(data)):
            counts[d].setdefault(data[k - d : k], Counter())[data[k]] += 1
    text, bits = text.lower().encode(), 0.0
    for k in range(len(text)):
        cost = 0.0
        d = 0
        while d < order and k - d - 1 >= 0 and sum(counts[d + 1].get(text[k - d - 1 : k], Counter()).values()) >= least:
            d += 1
        for d in range(d, -1, -1):
            c = counts[d][text[k - d : k]]
            total, kinds = sum(c.values()), len(c)
            if c[text[k]]:
                cost -= np.log2(c[text[k]] / (total + kinds))
                break
            cost -= np.log2(kinds / (total + kinds))
        else:
            cost += 8
        bits += cost
    return bits


def test_ppm_code_lengths():
    rng = random.Random(2)
    samples = {"a": [prose(rng, 150)], "b": ["zq " * 100 + "xyzzy plugh " * 40]}
    model = langid.Model({k: [t.lower().encode() for t in v] for k, v in samples.items()}, order=3, least=5)
    texts = ["zq plugh von!", prose(rng, 30), "Ünknown ~~ bytes", "a"]
    got = model.lengths([t.lower().encode() for t in texts])
    for k, t in enumerate(texts):
        for j, lang in enumerate("ab"):
            assert got[k, j] == pytest.approx(naive_cost(samples[lang], 3, 5, t), rel=1e-4), (t, lang)
    long = (texts[1] * 40).lower().encode()
    langid_segment, langid.SEGMENT = langid.SEGMENT, 1000
    try:
        assert model.long(long) == pytest.approx(model.lengths([long])[0], rel=1e-6)
    finally:
        langid.SEGMENT = langid_segment


def test_any_number_of_languages():
    rng = random.Random(8)
    samples = {f"l{k:02}": [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(40)).encode() * 3] for k in range(21)}
    model = langid.Model(samples, order=3, least=5)
    texts = [s[0][:60] for s in samples.values()]
    got = model.lengths(texts)
    assert len(model.parts) == 3 and got.shape == (21, 21) and (got.argmin(axis=1) == np.arange(21)).all()
    alone = np.concatenate([langid.Model({k: v}, order=3, least=5).lengths(texts) for k, v in samples.items()], axis=1)
    np.testing.assert_allclose(got, alone, rtol=1e-6)  # who shares a table changes no cost
    assert model.predict(["".join(chr(c) for c in t) for t in texts]) == [(k, pytest.approx(1, abs=1e-3)) for k in samples]


def test_every_language_is_learned(spark):
    rows = [(k, f"text number {k} of a common language " * 30, "aa") for k in range(60)] + [(100 + k, f"seldom{k} " * 400, f"z{k:03}") for k in range(150)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, remainder int")
    got = langid.sample(df, most=2000, total=30000)
    assert len(got) == 151 and all(len(v) == 1 for k, v in got.items() if k != "aa")
    assert {k: langid.sample(df, most=2000, total=30000)[k] for k in ("aa", "z149")} == {k: got[k] for k in ("aa", "z149")}


def test_language_accuracy_on_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identified(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_nothing(spark):
    rows = [(1, None), (2, ""), (3, "123 ... 456"), (4, "ein wort")]
    got = {r.doc_id: r for r in langid.identified(table(spark, rows)).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in ("en", "und")
    assert got[1].score == 0


# --- op 4 -----------------------------------------------------------------------


def naive_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    fives = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(fives)
    covered = {k + j for k, f in enumerate(fives) if often[f] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_features_and_verdicts(spark, corpus):
    got = {r.doc_id: r for r in quality.judged(table(spark, corpus)).collect()}
    for i, t in corpus:
        want = naive_features(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, i
        assert got[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert not any(got[i].kept for i in (200, 201, 202, 203, 204, 206, 207))
    clean = [i for i, t in corpus if i < 60 and not got[i].base_failed]
    assert all(got[i].kept for i in clean)


def test_em_finds_accuracies(spark):
    """Good documents, and two kinds of bad ones with a fault each that the other never has."""
    rng = random.Random(4)
    rows = []
    for _ in range(4000):
        kind = rng.choices(["good", "junk", "shouted"], [0.8, 0.12, 0.08])[0]
        rows.append(tuple(rng.choices([-1, 0, 1], [0.8, 0.1, 0.1] if name in quality.KINDS.get(kind, ()) else [0.02, 0.1, 0.88])[0] for name, _, _ in quality.RULES))
    theta = quality.fit(spark.createDataFrame(rows, ", ".join(f"v_{n} int" for n, _, _ in quality.RULES)))
    assert theta["s_good"] == pytest.approx(0.8, abs=0.05) and theta["s_junk"] == pytest.approx(0.12, abs=0.03) and theta["s_shouted"] == pytest.approx(0.08, abs=0.03)
    assert theta["n_junk_symbols"] > 0.7 and theta["n_good_symbols"] < 0.05
    right = quality.accuracies(theta)
    assert right["symbols"] > 0.85 and right["shouting"] > 0.8


def test_no_single_vote_decides(spark):
    """Of documents with one bad vote some are kept, and some without any bad vote go."""
    voted = quality.votes(quality.judged(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("not base_failed"))
    bad = sum((F.col(f"v_{n}") == -1).cast("int") for n, _, _ in quality.RULES)
    got = {(r.bad, r.kept): r["count"] for r in voted.groupBy(bad.alias("bad"), "kept").count().collect()}
    assert got[1, True] > 20 and got[1, False] >= 1 and got[0, False] >= 1 and got[2, True] >= 1 and got[2, False] > 100
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    by = {(r.quality, r.kept): r["count"] for r in voted.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert by[0, False] >= 0.98 * (by[0, False] + by.get((0, True), 0)) and by[1, True] >= 0.998 * (by[1, True] + by.get((1, False), 0))


# --- op 5 -----------------------------------------------------------------------


def naive_removed(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), kept
    return out


def test_repeated_strings_against_brute_force(spark, corpus):
    got = suffix_dedup.removed(table(spark, corpus)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == naive_removed(corpus)


def test_anchors_known_from_the_sample_change_nothing(spark, monkeypatch):
    """Places of anchors that the sample shows skip the count; the same strings go, with copies and repeated ids too."""
    rng = random.Random(12)
    passage = prose(rng, 40)
    rows = [(k, f"{prose(rng, 12)} {passage} {prose(rng, 12)}") for k in range(60)]
    rows += [(k, rows[k % 7][1]) for k in range(60, 90)]
    seen = {}
    find = suffix_dedup.hot_anchors
    monkeypatch.setattr(suffix_dedup, "hot_anchors", lambda some, nth: seen.update(find(some, nth, 8, 0)) or {h: suffix_dedup.HOT + c for h, c in seen.items()})
    got = suffix_dedup.removed(table(spark, rows)).collect()
    assert seen and {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == naive_removed(rows)


def test_anchors_do_not_depend_on_what_lies_beside_a_text():
    text = np.frombuffer(prose(random.Random(3), 200).encode(), np.uint8)
    alone = suffix_dedup.anchors(text, np.array([len(text)]))
    more = np.r_[text, np.tile(text, 400)]
    both = suffix_dedup.anchors(more, np.array([len(text), len(more)]))
    assert all(np.array_equal(a, b[: len(a)]) for a, b in zip(alone, both, strict=True))


def test_repeated_rows_keep_their_text(spark):
    text = prose(random.Random(9), 60)
    got = suffix_dedup.removed(table(spark, [(5, text), (5, text), (6, text), (None, "x")])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (5, 0), (5, 0), (6, len(text.encode()))]


@pytest.mark.parametrize("count", [2, suffix_dedup.HOT + 1, suffix_dedup.HUGE + 1])
def test_hot_anchors_are_dealt_out_without_loss(count):
    """The same removals whether an anchor's windows go together, in ranges or one by one."""
    rng = random.Random(8)
    phrase = bytes(rng.randrange(97, 123) for _ in range(140))
    texts = [bytes(rng.randrange(97, 123) for _ in range(rng.randint(0, 150))) + phrase[rng.randint(0, 20) : rng.randint(90, 140)] + bytes(rng.randrange(97, 99) for _ in range(150)) for _ in range(30)]
    texts += [b"ab" * 200, b"ab" * 150]
    buckets: dict = {}
    for doc, t in enumerate(texts):
        data = np.frombuffer(t, np.uint8)
        at, *_ = suffix_dedup.anchors(data, np.array([len(data)]))
        for begin, lead, off, part in suffix_dedup.contexts(t, [(k, count) for k in range(len(at))]):
            buckets.setdefault(lead, []).append((lead, off, part, doc, doc, begin))
    gone: dict = {}
    for rows in buckets.values():
        for doc, _, a, z in suffix_dedup.bucket_removals(rows):
            gone.setdefault(doc, []).append({"a": a, "z": z})
    want = naive_removed([(k, t.decode()) for k, t in enumerate(texts)])
    for doc, t in enumerate(texts):
        cut = suffix_dedup.spans(gone.get(doc))
        assert (len(t), sum(z - a for a, z in cut), len(cut), suffix_dedup.left(t, cut)) == want[doc]


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    starts = np.arange(2800)
    order, run = suffix_dedup.suffix_runs(data, starts, 20)
    by = {}
    for s in starts.tolist():
        by.setdefault(data[s : s + 20].tobytes(), []).append(s)
    want = {tuple(v) for v in by.values() if len(v) > 1}
    got = {}
    for o, r in zip(order.tolist(), run.tolist(), strict=True):
        got.setdefault(r, []).append(o)
    assert {tuple(sorted(v)) for v in got.values()} == want
    keys = [data[o : o + 20].tobytes() for o in order]
    assert keys == sorted(keys)


# --- op 6 -----------------------------------------------------------------------


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([3, 1, 0.5], 400)
    rows = [(k, int(rng.integers(5, 500)), *map(float, p[k])) for k in range(400)] + [(1000, 0, 0.3, 0.3, 0.4)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_good double, p_low double, p_toxic double")
    targets = {"good": 0.8, "low": 0.15, "toxic": 0.05}
    got = mixing.rates(df, targets, rounds=60).collect()
    total = sum(r.n_tokens for r in got)
    for d, share in targets.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) / total == pytest.approx(share, abs=0.01)
    assert all(r.rate >= 0 for r in got)
    # the same steps in numpy
    n, q = np.array([r[1] for r in rows], float), np.array([r[2:] for r in rows])
    rate, want, total = np.ones(len(n)), np.array(list(targets.values())), ((n @ q) / n.sum()).sum() * n.sum()
    for _ in range(60):
        error = (rate * n) @ q / total - want
        if np.abs(error).max() <= mixing.OFF:
            break
        h = (q * (n * (rate > 0))[:, None]).T @ q / total + 1e-4 * np.eye(3)
        rate = np.maximum(0, rate * (1 - mixing.PULL) + mixing.PULL - q @ np.linalg.solve(h, error))
    assert np.allclose([r.rate for r in sorted(got, key=lambda r: r.doc_id)], rate[np.argsort([r[0] for r in rows])], atol=1e-6)
    assert mixing.rates(df, {"good": 0.8, "low": 0.15, "toxic": 5.0}).where("rate < 0 or rate is null").count() == 0


def test_mixing_by_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = mixing.mixed(docs, labels).join(labels, "doc_id").collect()
    mean = lambda c, q, t: np.mean([r[c] for r in got if r.quality == q and r.toxic == t])
    assert mean("p_good", 1, 0) > 0.9 and mean("p_low", 0, 0) > 0.8 and mean("p_toxic", 1, 1) > 0.6
    assert mean("rate", 1, 0) > 1 > mean("rate", 1, 1) and all(abs(r.copies - r.rate) < 1 for r in got)
    mixed = mixing.remix(docs, labels)
    assert mixed.columns == docs.columns
    assert mixing.mixed(docs.limit(0), labels.limit(0)).count() == 0
    plain = mixing.mixed(table(spark, [(1, None), (2, "a b"), (2, "a b")]), labels.limit(0)).collect()
    assert len(plain) == 3 and all(abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 for r in plain)


# --- op 7 -----------------------------------------------------------------------


def test_bpe_equals_library(spark, corpus):
    import tiktoken

    ranks, pattern = bpe.vocabulary()
    codec = bpe.Codec(ranks, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(6)
    odd = ["".join(rng.choice(["a", " ", "\n", "  ", "\x1c", "\x85", "don't", "12", "é", "漢", "\U0001f600", "<|endoftext|>", "\xa0", "ſ", "x" * 50]) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    rows = [*corpus, *((1000 + k, t) for k, t in enumerate(odd))]
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (64, 24)):
        got = {r.doc_id: list(r.ids) for r in bpe.encoded(table(spark, rows), chunk=chunk, overlap=overlap).collect()}
        assert got == {i: library.encode_ordinary(t or "") for i, t in rows}
    for r in bpe.digested(bpe.encoded(table(spark, rows))).join(table(spark, rows), "doc_id").collect():
        ids = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def merged(ranks, piece):
    """Ids of a piece: the pair with the least rank, the first of them, joins until none has a rank."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[x] for x in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_merges_against_brute_force(corpus):
    codec = bpe.Codec(*bpe.vocabulary())
    rng = random.Random(16)
    pieces = {p for _, t in corpus[:60] for p in codec.pieces(t or "")} | {"".join(rng.choice("aabetz é漢\n=\U0001f600") for _ in range(rng.randint(1, 60))) for _ in range(300)}
    for p in [*pieces, "a" * 700, " \n" * 300]:
        assert np.frombuffer(codec.packed([p]), np.int32).tolist() == merged(codec.ranks, p.encode()), p


# --- op 9 -----------------------------------------------------------------------


def test_automaton_matches_brute_force():
    rng = random.Random(3)
    seqs = [[rng.randrange(3) for _ in range(rng.randint(3, 12))] for _ in range(4)]
    auto = license_scan.Automaton(seqs)
    text = [rng.randrange(4) for _ in range(400)]
    subs = {tuple(s[a:b]) for s in seqs for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    state = length = 0
    for k, t in enumerate(text):
        while state and t not in auto.next[state]:
            state = auto.link[state]
            length = auto.len[state]
        if t in auto.next[state]:
            state, length = auto.next[state][t], length + 1
        else:
            state = length = 0
        want = max((n for n in range(0, 13) if n <= k + 1 and (n == 0 or tuple(text[k + 1 - n : k + 1]) in subs)), default=0)
        assert length == want
        assert {(q, e) for q, e in auto.ends[state]} == {(q, e) for q, s in enumerate(seqs) for e in range(length, len(s) + 1) if length and s[e - length : e] == text[k + 1 - length : k + 1]}


def test_licences(spark):
    mit = dict(license_scan.TEMPLATES)["isc"]
    rows = [
        (1, "The GNU General Public-License. apache LICENSE, CC-BY and mit\nlicense; cc by"), (2, None), (3, ""), (4, "no such words here"), (5, f"words before {mit} words after"), (6, f"{mit[: len(mit) // 2]} broken off"),
        (7, "gnu general public gnu general public license"), (8, "Licensed under the Apache License, Version 2.0."), (9, "mit License " * 3), (10, "CC BYé"),
    ]
    got = {r.doc_id: r for r in license_scan.scanned(table(spark, rows)).collect()}
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((p[0] for p in places), default=None), max((p[0] for p in places), default=None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert "isc" in got[5].labels and got[5].score == 1 and (got[5].spans[0].first_word, got[5].n_words - got[5].spans[0].end_word) == (2, 2)
    assert "isc" not in got[6].labels and 0.3 < got[6].score < 0.7 and got[8].labels == "apache,apache-2.0"
