"""Cases that a review found left out."""

import random

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F

from pixloom.llm import html_text, license_scan, mixing, quality, simhash
from pixloom.llm.common import documents

FORM = "doc_id long, text string, lang string, source string, n_chars long"
CLEAN = "The council met on Monday and agreed, after a long debate, that the old bridge over the river should be repaired before winter. Work starts next week."


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], FORM)


def five(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def naive_groups(texts):
    """The smallest index of each text's component, by all pairs."""
    sets, of = [five(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return of


def test_near_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 10)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    texts, passage = [], " ".join(f"p{k}" for k in range(25))
    for _ in range(25):
        text = [word() for _ in range(rng.randint(3, 150))]
        texts.append(" ".join(text))
        for _ in range(rng.randint(0, 6)):
            copy = list(text)
            for _ in range(rng.randint(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randint(1, 12)))}" for _ in range(25)]  # about as similar as the limit
    want = naive_groups(texts)
    got = simhash.keep_first(table(spark, enumerate(texts))).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want)) and len(set(want)) < len(texts)
    assert {len(got)} == {simhash.keep_first(table(spark, list(enumerate(texts)) * 2)).count()}


def test_pipeline_drops_planted_near_copies(spark):
    rng = random.Random(12)
    text = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(0, " ".join(text)), (9, "something else that nobody copied at all")]
    for k in range(1, 6):  # three words in 200 replaced: a similarity of about 0.86, often over four bits apart
        copy = list(text)
        for at in (30, 90, 150):
            copy[at + k] = f"x{k}"
        rows.append((k, " ".join(copy)))
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 9]


def test_documents_without_an_id_survive_each_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    junk = "### $$$ *** " * 60
    more = table(spark, [(None, CLEAN), (None, junk), (777777, CLEAN.replace("council", "committee").replace("river", "railway").replace("winter", "spring")), (777777, junk)])
    docs = docs.unionByName(more.select(docs.columns))
    found = lambda df, text: df.where((F.col("doc_id").isNull() | (F.col("doc_id") == 777777)) & (F.col("text") == text)).count()
    good = quality.keep_good(docs).cache()
    assert found(good, CLEAN) == 1 and found(good, junk) == 0 and good.where("doc_id = 777777").count() == 1
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.suffix_dedup):
        assert found(stage(spark, good, sf), CLEAN) == 1, stage
    assert found(simhash.keep_first(good), CLEAN) == 1
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    copies = mixing.mixed(good, labels).where("doc_id is null").first().copies
    assert copies >= 1 and found(mixing.remix(good, labels), CLEAN) == copies
    assert corpus_pipeline.encode(spark, good, sf).where("doc_id is null").count() == 1


def test_first_and_last_lines_keep_their_white_space(spark):
    rows = [" foo\n foo", "foo\nfoo ", "foo\r\nfoo\r\n", "\tx\n\tx\nx", "a\na", "  a\nb\n  a\n"]
    got = {r.doc_id: (r.n_dup_lines, r.n_lines) for r in quality.features(table(spark, enumerate(rows))).collect()}
    assert got == {0: (1, 2), 1: (0, 2), 2: (1, 2), 3: (1, 3), 4: (1, 2), 5: (1, 3)}


def test_html_pages_are_not_cut_to_a_prefix():
    first, last = "The first paragraph has quite a few words in it.", "The last paragraph has quite a few words as well."
    page = lambda odd, between="": f"<body><header><form>{odd}</form></header><article><p>{first}</p>{between}<p>{last}</p></article></body>"
    want = f"{first}\n\n{last}"
    for odd in ("<datalist id=x><option value=a>A<option value=b>B</datalist>", "<select><option>A<option>B</select>", "<button>Go", "<svg><path d='M0'>", "<button>Go<button>Stop</button>", "<noscript><div><p>No</div>", "<option>A"):
        assert html_text.main_text(page(odd)) == want, odd
    for between in ("<div><video src=x></div>", "<div><object><object></object>hidden</object></div>", "<div><iframe src=x></div>", "<div><button><div>a</div>b</div>", "<script>'</article>'</script>", "<img alt=John's>", '<img title="5" tall">', '<img alt=a="b>', "<img alt = 'a > b'>", '<img alt="a > b">', "<template><style>'</template>'</style>x</template>"):
        assert html_text.main_text(page("", between)) == want, between
    for text in ("<p title=John's>", '<p title="5" tall">'):
        assert html_text.main_text(f"<article>{text}{first}</p><p title='x' class=\"y\">{last}</p></article>") == want, text
    formula = "<p>The area is <math><mi>r</mi><mo>\u00b7</mo><mi>s</mi></math> for these two sides.</p>"
    assert html_text.main_text(page("", formula)) == f"{first}\n\nThe area is r\u00b7s for these two sides.\n\n{last}"


def test_every_copy_of_a_licence_is_a_span(spark):
    isc, mit = dict(license_scan.TEMPLATES)["isc"], dict(license_scan.TEMPLATES[:1])["mit"]
    n, cut = len(license_scan.tokens(isc.encode())), isc.replace("any purpose", "each and every aim")
    rows = [
        (1, f"{isc} {isc}"), (2, f"{isc} {'other words here ' * 30} {cut} {isc}"), (3, "All rights reserved. " * 5 + "x " * 40 + "all rights reserved"), (4, isc), (5, isc[: len(isc) // 2]),
        (6, f"{isc} {mit} {isc} {mit}"), (7, "all rights reserved " * 20000), (8, f"{isc[:100]} all rights reserved {isc[100:]} all rights {isc} reserved"),
    ]
    got = {r.doc_id: [(s.label, s.first_word, s.end_word) for s in r.spans] for r in license_scan.scanned(table(spark, rows)).collect()}
    assert got[1] == [("isc", 0, n), ("isc", n, 2 * n)]
    assert got[2] == [("isc", 0, n), ("isc", n + 90, 2 * n + 92), ("isc", 2 * n + 92, 3 * n + 92)]
    assert got[3] == [("all-rights-reserved", k, k + 3) for k in (0, 3, 6, 9, 12, 55)]
    assert len(got[4]) == len(got[5]) == 1 and [s[0] for s in got[6] if s[0] in ("isc", "mit")] == ["mit", "mit", "isc", "isc"]
    assert len(got[7]) == 20000 and [s[0] for s in got[8]].count("isc") == 2


def test_a_chain_grows_past_many_matches():
    """Seventy places of a phrase lie between the two halves of a chain."""
    head, tail, phrase = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("h", 10), ("t", 10), ("p", 5)))
    template = f"{head} {tail} " + " ".join(f"x{k} {phrase}" for k in range(70))
    scanner = license_scan.Scanner((("no such", "other"),), (("own", template),))
    (span,) = scanner.spans(scanner.scan(license_scan.tokens(f"{head} {phrase} {tail}".encode()))[1])
    assert span == (1, 20 / len(template.split()), 0, 25)
