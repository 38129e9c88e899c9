"""Periodic runs, toxicity and centroid clustering against brute force and on odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from pixloom.llm import periodic_runs, sort_means, toxicity

FORM = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra=""):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], FORM)
    return df.selectExpr("*", "1 as n", "2 as words", "'x' as runs", "3 as toxic", "4 as terms", "5 as cluster") if extra else df


# --- op 11 ----------------------------------------------------------------------


def naive_runs(s, least=12):
    best, n = {}, len(s)
    for q in range(1, n):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b - a, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


def texts_of(rng):
    for k in range(400):
        size, n = rng.choice([1, 2, 2, 3, 30]), rng.randint(0, 90)
        out = [rng.randrange(size) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):  # periodic parts, some inside others
            at, p = rng.randint(0, len(out)), rng.randint(1, 9)
            base = [rng.randrange(size) for _ in range(p)] if len(out) < p + 1 or rng.random() < 0.5 else out[:p]
            out[at:at] = [base[i % p] for i in range(rng.randint(1, 40))]
        yield out


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_against_all_periods(least):
    rng = random.Random(least)
    found = 0
    for s in texts_of(rng):
        got = periodic_runs.runs_of(np.array(s, np.int64), least)
        assert got == naive_runs(s, least)
        found += len(got)
    assert found > 400


def test_z_lengths():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randint(0, 30))]
        want = [0] + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
        assert periodic_runs.z_lengths(np.array(s, np.int64)).tolist() == want[: len(s)]


def test_long_periodic_text():
    s = np.array([i % 3 for i in range(200_000)])
    assert periodic_runs.runs_of(s) == [(0, 200_000, 3)]
    assert periodic_runs.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


ODD = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "a " * 30), (4, "a " * 30), (None, "b c " * 9), (None, None), (5, "x\x00 y z " * 8), (6, "one two three four five six seven eight nine ten eleven twelve"), (7, "w " * 11)]


def test_runs_of_odd_rows(spark):
    assert periodic_runs.periodic_runs(table(spark, [])).collect() == []
    got = periodic_runs.periodic_runs(table(spark, ODD, extra="x")).collect()
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 30, [(0, 30, 1)], "a"), (4, 30, [(0, 30, 1)], "a"), (None, 18, [(0, 18, 2)], "b c"), (None, 0, [], ""),
        (5, 16, [(0, 16, 2)], "x\x00 y z"), (6, 12, [], ODD[8][1]), (7, 11, [], " ".join("w" * 11)),
    ], key=str)


def naive_op11(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = naive_runs(words)
    gone = {i for a, k, q in runs for i in range(a + q, a + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{k},{q}\n" for a, k, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_against_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("ab cd e fgh".split()[: 1 + i % 4]) for _ in range(rng.choice([3, 12, 40, 90]))) + rng.choice([" ", "\n", ""])) for i in range(120)] + [x for x in ODD if x[0] is not None and "\x00" not in (x[1] or "")]
    path = str(tmp_path / "documents.parquet")
    table(spark, rows).coalesce(1).write.parquet(path)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, periodic_runs.op11_runs(spark, str(tmp_path)).select(*names).collect()), key=str)
    assert got == sorted((naive_op11(i, t) for i, t in rows), key=str)
    assert sum(r[1] for r in got) > 20
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}/*.parquet'")
    assert sorted(c.sql(periodic_runs.OP11_SQL).project(", ".join(names)).fetchall(), key=str) == got


# --- op 12 ----------------------------------------------------------------------


def labelled_texts(n, seed):
    """Toxic are texts with both an insult and a group; two insults, or two groups, alone are not."""
    rng = random.Random(seed)
    plain, insults, groups = [f"w{k}" for k in range(60)], ["zupa", "krol", "blet"], ["marten", "sorbin", "qualor"]
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 25))]
        kind = rng.choice(["none", "insults", "groups", "both"])
        words += {"none": [], "insults": rng.sample(insults, 2), "groups": rng.sample(groups, 2), "both": [rng.choice(insults), rng.choice(groups)]}[kind]
        rng.shuffle(words)
        yield i, " ".join(words), int(kind == "both")


def test_pairs_weigh_what_single_terms_do_not(spark):
    rows = list(labelled_texts(2400, 1))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = table(spark, [(i, t) for i, t, _ in rows])
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    held = [(got[i].score, y) for i, _, y in rows if got[i].held_out]
    assert 500 < len(held) < 700 and {got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows} == {True}
    assert np.mean([(s >= toxicity.TOXIC) == y for s, y in held]) > 0.97
    # a model of the same terms without pairs can't: two insults, or two groups, weigh as much as one of each
    kept, _ = toxicity.learned(docs, labels)
    terms = toxicity.Terms(kept)
    train = [x for x in rows if not got[x[0]].held_out]
    linear = toxicity.fitted([terms.of(t) for _, t, _ in train], np.array([y for *_, y in train]), len(kept), factors=1, rate=0.02)
    linear.factors[:] = 0
    alone = linear.scores([terms.of(t) for i, t, _ in rows if got[i].held_out])
    assert np.mean([(s >= toxicity.TOXIC) == y for s, (_, y) in zip(alone, held, strict=True)]) < 0.9


def test_scores_of_machine_are_sums_over_pairs():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(-0.5, rng.normal(size=9), rng.normal(size=(9, 3)))
    rows = [np.array([], np.int64), np.array([4]), np.array([0, 2, 8]), np.arange(9)]
    for got, row in zip(machine.scores(rows), rows, strict=True):
        odds = machine.bias + machine.weights[row].sum() + sum(machine.factors[a] @ machine.factors[b] for k, a in enumerate(row) for b in row[k + 1 :])
        assert got == pytest.approx(1 / (1 + np.exp(-odds)))


def test_odd_rows_and_labels(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "some text"), (3, "w " * 100_000), (4, "\x00 é")]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(table(spark, []), none).collect() == []
    assert len({r.score for r in toxicity.scored(table(spark, rows, "x"), none).collect()}) == 1
    odd = spark.createDataFrame([(1, 1, "a"), (1, 0, "a"), (None, 1, "b"), (2, None, "c"), (3, 7, "d"), (99, 1, "e")], "doc_id long, toxic int, text string")
    got = toxicity.scored(table(spark, rows, "x"), odd).collect()
    assert sorted(((r.doc_id, r.held_out) for r in got), key=str) == sorted([(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows], key=str)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_labels_of_held_out_rows_and_order_change_nothing(spark):
    rows = list(labelled_texts(400, 5))
    docs = table(spark, [(i, t) for i, t, _ in rows])
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
    one = toxicity.scored(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()
    two = toxicity.scored(docs.repartition(7), spark.createDataFrame(flipped[::-1], "doc_id long, toxic int")).collect()
    assert sorted(one) == sorted(two)


def test_bound_of_the_labelled_sample(spark):
    rows = list(labelled_texts(200, 6))
    docs, labels = table(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert toxicity.scored(docs, labels, labelled=50).count() == 200


# --- op 13 ----------------------------------------------------------------------


def naive_clusters(rows, size, k, rounds, scale=1024):
    """rows of (id, vector or None) by plain Python; no row without an id, no ids twice."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())
    centres = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in kept), centres


def vectors(rng, n, size, kinds=6):
    heads = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(kinds)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(heads)]) for i in range(n)]


@pytest.mark.parametrize(("size", "k", "scale"), [(3, 5, 1024), (2, 8, 4), (1, 3, 1), (4, 4, 1 << 40)])
def test_clusters_against_all_distances(spark, size, k, scale):
    rows = vectors(random.Random(size + k), 150, size)
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(300, None), (301, []), (302, [0.5] * (size + 1)), (303, [None] * size), (304, [float("nan")] * size), (305, [float("-inf")] * size)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cluster", "2 as v", "3 as id").repartition(5)
    got, centres = sort_means.sort_means(df, size=size, k=k, rounds=6, scale=scale)
    want, others = naive_clusters(rows, size, k, 6, scale)
    assert sorted(map(tuple, got.collect())) == [(i, c, d if d < 1 << 63 else None) for i, c, d in want]
    assert centres == others


def test_scan_stops_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(4)
    for _ in range(300):
        k = rng.integers(1, 7)
        x, centres = rng.integers(-4, 5, (30, 2)), rng.integers(-4, 5, (k, 2))
        all_ = ((x[:, None] - centres[None]) ** 2).sum(-1)
        now, d = sort_means.assigned(x, rng.integers(0, k, 30), centres)
        assert (now == all_.argmin(1)).all() and (d == all_.min(1)).all()


def test_odd_vectors(spark):
    form = "vec_id long, embedding array<double>"
    empty, centres = sort_means.sort_means(spark.createDataFrame([], form))
    assert empty.collect() == [] and centres == []
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [3.0, 1.0]), (None, None), (2, [1e300, 0.0]), (3, [1.7e308, 0.0])]
    got, centres = sort_means.sort_means(spark.createDataFrame(rows, form), size=2, k=2, rounds=3)
    # equal vectors share the first centroid; the vector of 1e300 is nearer to neither, and its distance fits no 64 bits
    assert len(centres) == 2
    assert sorted((r.vec_id or 0) for r in got.collect()) == [0, 1, 1, 2]


def test_op13_against_sql(spark, tmp_path):
    rows = vectors(random.Random(9), 400, 64) + [(900, None), (901, [0.1] * 63)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    got = sort_means.op13_centroids(spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{path}/*.parquet'")
    want = c.sql(sort_means.op13_sql()).project(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 400
    assert len({r[5] for r in want}) == len({r[1] for r in want}) > 3
