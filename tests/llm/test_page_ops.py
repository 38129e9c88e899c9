"""WARC archives, HTML text, audio fingerprints and the pipeline."""

import hashlib
import os

import numpy as np
import pytest

from pixloom.llm import html_text, media, warc
from pixloom.llm.queries import oracle_sql, queries

PAGES = "page_id long, url string, html string"
BIG, SMALL = "<p>" + "long page " * 40 + "</p>", "<p>x</p>"


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/5", BIG), (3, "http://a/3", BIG), (9, None, BIG), (1, "u", SMALL), (2, "u\r\nX: y", SMALL), (7, "u", None), (8, "u", ""), (None, "u", BIG), (4, "ü", "é" * 60), (6, "u", "é" * 60), (6, "u", "é" * 60)]
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.records(spark.createDataFrame(rows, PAGES)).repartition(3).write.format("warc").mode("append").save(path)
    got = {}
    for r in spark.read.format("warc").load(path).collect():
        got.setdefault(r.record_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert got["urn:page:3"][0].record_type == "response" and bytes(got["urn:page:3"][0].payload).decode() == BIG
    for k in ("5", "9", "none"):
        r = got[f"urn:page:{k}"][0]
        assert r.record_type == "revisit" and r.refers_to == "urn:page:3" and r.payload is None and r.payload_length == len(BIG)
        assert r.payload_digest == hashlib.sha256(BIG.encode()).hexdigest()
    assert all(got[f"urn:page:{k}"][0].record_type == "response" for k in (1, 2, 7, 8, 4)) and len(got["urn:page:6"]) == 2
    assert got["urn:page:2"][0].target_uri == "u%0D%0AX: y" and got["urn:page:9"][0].target_uri is None
    only = spark.read.format("warc").load(path).where("record_type = 'revisit' and refers_to = 'urn:page:3'")
    assert only.count() == 3
    heads = spark.read.format("warc").schema("record_type string, record_id string").load(path)
    assert heads.where("record_id like 'urn:page:%' and record_type in ('response')").count() == 6
    assert spark.read.format("warc").load(path).where("record_id is null").count() == 0


def test_warc_reader_skips_payloads(tmp_path, monkeypatch):
    row = dict(record_type="response", record_id="urn:a", target_uri="u", date="d", refers_to=None, payload_digest="0", payload_length=9, payload=b"x" * 9)
    with open(tmp_path / "f.warc", "wb") as f:  # plain records and members without a length are read too
        f.write(warc.record(row) + warc.record(row | {"record_id": "urn:b"}))
    import gzip

    with open(tmp_path / "g.warc.gz", "wb") as f:
        f.write(gzip.compress(warc.record(row)) + warc.member(warc.record(row | {"record_id": "urn:b", "payload": b"y" * 100_000})))
    reader = warc.WarcReader(str(tmp_path), ["record_id", "payload"])
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert len(list(reader.pushFilters([EqualTo(("record_id",), "urn:b"), GreaterThan(("payload_length",), 3)]))) == 1
    calls = []
    block = warc._Member.block
    monkeypatch.setattr(warc._Member, "block", lambda self: calls.append(1) or block(self))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_id"] for r in rows] == ["urn:b", "urn:b"] and len(calls) == 2 and len(rows[1]["payload"]) == 100_000


def test_warc_empty(spark, tmp_path):
    warc.register(spark)
    warc.records(spark.createDataFrame([], PAGES)).write.format("warc").mode("append").save(f"{tmp_path}/none")
    assert spark.read.format("warc").load(f"{tmp_path}/none").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>"; if (a<b) {}</script></head><body class="post">
<header><h1>Site name</h1><p>Slogan of the site that is long enough to look like a paragraph of text, indeed.</p></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
<div id="cookie-notice">We use cookies on this site and you must agree to it or leave it at once, please.</div>
<article><h1>The &amp; title</h1><p>First <b>bold</b>&nbsp;text<br>with   a break &#233; &lt;x&gt;.<p>Short.</p><div class="ad">Buy this thing now, it is the best thing that you will ever have bought anywhere.</div><p>Second paragraph, with <a href="z">a link</a> in it and a good many words beside it.</p>
<form><p>Your name here and your mail address there, then send it to us.</p><input></form><section class="comments"><p>A reader says that this article is long and very good to read.</p></section></article>
<aside class=sidebar><p>Related articles that you may want to read after this one.</p></aside><footer>&copy; somebody</footer></body></html>"""


def test_html_page():
    assert html_text.main_text(PAGE) == "The & title\n\nFirst bold text with a break é <x>.\n\nShort.\n\nSecond paragraph, with a link in it and a good many words beside it."
    for odd in (None, "", "<", "<p", "<!-- ", "<script>", "<div class='x", "&&&#xfffffff;", "</p></div>", "<p>" * 2000, "a" * 10000):
        html_text.main_text(odd)
    plain = "<div>" + "".join(f"<p>Paragraph {k} without any article element but with quite a few words in it.</p>" for k in range(4)) + "</div><div><a href=a>Home</a> <a href=b>About</a></div>"
    assert html_text.main_text(plain).count("Paragraph") == 4 and "About" not in html_text.main_text(plain)


def test_html_tree_fits_its_table():
    x, y = html_text.labelled()
    assert np.mean([html_text.decide(html_text.tree(), r) == bool(v) for r, v in zip(x, y, strict=True)]) == 1


def generated(rng, named):
    """A page and its main text; with names, of one of several layouts."""
    word = lambda: "".join(rng.choice(list("abdegilmnorst"), rng.integers(2, 9)))
    say = lambda low, high: " ".join(word() for _ in range(rng.integers(low, high)))
    links = lambda: "<ul>" + "".join(f"<li><a href='/{word()}'>{say(1, 3)}</a>" for _ in range(rng.integers(3, 8))) + "</ul>"
    blocks = [("h1", say(3, 12))] + [("p" if rng.random() < 0.85 else "h2", say(25, 80)) for _ in range(rng.integers(3, 9))]
    if named:
        blocks += [("p", say(1, 15)) for _ in range(rng.integers(0, 4))]
    body = "\n".join(f"<{t}>{x}</{t}>" for t, x in blocks)
    want = "\n\n".join(x for _, x in blocks)
    if not named:
        return f"<body><div>{links()}</div><div>{body}</div><div>{links()}</div></body>", want
    kind = rng.integers(3)
    at = body.index("</h1>") + 5
    advert = f"<div class='{rng.choice(['ad', 'ad-box', 'sponsored', 'share-links', 'cookie-notice'])}'><p>{say(3, 40)}</p></div>"
    body = body[:at] + advert + body[at:]
    comments = f"<section id=comments><h3>{say(1, 3)}</h3><p>{say(5, 40)}</p><p>{say(5, 40)}</p></section>"
    if kind == 0:
        return f"<header><p>{say(2, 30)}</p><nav>{links()}</nav></header><article>{body}{comments}</article><footer>{say(2, 20)}</footer>", want
    if kind == 1:
        return f"<div class=navbar>{links()}</div><div class='post-content'>{body}</div>{comments}<div class='sidebar widget-area'><p>{say(4, 40)}</p></div>", want
    return f"<div class='search-results-page'><main>{body}<aside>{say(4, 30)}</aside></main>{comments}<form><p>{say(2, 20)}</p></form></div>", want


def test_generated_pages():
    rng = np.random.default_rng(5)
    pages = [generated(rng, True) for _ in range(300)]
    assert np.mean([html_text.main_text(h) == w for h, w in pages]) >= 0.97
    plain = [generated(rng, False) for _ in range(300)]  # nothing but counts and link densities to go by
    assert np.mean([html_text.main_text(h) == w for h, w in plain]) >= 0.8
    assert sum(html_text.main_text(h) != html_text.main_text(h, names=False) for h, _ in plain) == 0


def test_names_of_elements_decide_little():
    text = "Only one paragraph of plain text stands in the middle of this page, and it has enough words to be read as such by anyone who cares."
    assert html_text.main_text(f'<div class="search-results-page"><p>{text}</p></div>') == text
    assert html_text.main_text(f'<article><p>{text}</p><p class="share-of-voice">{text} And more.</p></article>') == f"{text}\n\n{text} And more."
    root = html_text.tree()
    assert html_text.FEATURES[root[0]] != "named" and all(html_text.FEATURES[n[0]] != "named" for n in root[2:] if isinstance(n, tuple))


ARTICLE = "<h1>{0}</h1><p>{1}</p><p>{2}</p><p>{3}</p>".format("A short title of a page", "one two three four five six " * 6, "seven eight nine " * 7, "ten eleven twelve thirteen " * 9)
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li><li><a href=/c>Our news</a></li></ul>"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>"])
def test_html_frame_without_known_names(around):
    want = html_text.main_text(f"<article>{ARTICLE}</article>")
    assert want.count("\n\n") == 3
    body = around.format(ARTICLE)
    said = "<p>What a good article this is, I have read it twice.</p><p>I don't agree with a word of it, and I never shall, whoever says it.</p>"
    for before, after in (
        ("", f'<section class="user-comments">{said}</section>'), ("", f'<div id="readers_comments">{said}</div>'),
        ('<div class="cc-window">We use cookies to give you the best visit of our pages.</div>', ""), ("", '<div class="cc-window">We use cookies to give you the best visit of our pages.</div>'),
        ("<div>Home | About</div>", ""), (MENU, "<div>Home | About | Imprint</div>"), (MENU + "<p>Current</p>" + MENU, ""), (MENU, f"<h3>Read on</h3>{MENU}"),
    ):
        assert html_text.main_text(f"<body>{before}{body}{after}</body>") == want, (before, after)
    for name in ("has-comments", "no-comments entry", "with-newsletter"):
        assert html_text.main_text(f'<body><div class="{name}">{body}</div></body>') == want, name


def test_html_tree_uses_links_of_both_neighbours():
    def used(node):
        return {html_text.FEATURES[node[0]]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()

    assert used(html_text.tree()) >= {"words_before", "links_before", "words", "links", "words_after", "links_after"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_html_counts_carry_the_result(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    changed = [html_text.main_text(h) != html_text.main_text(h, names=False) for h in pages]
    assert np.mean(changed) < 0.1


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "", "")], PAGES).selectExpr("*", "'x' as text", "5 as n_chars")
    got = html_text.extracted(df).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got)[:2] == [0, 0] and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extracted(df.limit(0)).count() == 0


def sound(seed, notes=50, start=0, noise=0.0):
    rng = np.random.default_rng(seed)
    hz = np.repeat(440 * 2 ** (rng.integers(-20, 12, notes)[start:] / 12), 500)
    x = 0.5 * np.sin(2 * np.pi * np.cumsum(hz) / 4000)
    return media.wav(x + noise * np.random.default_rng(1).standard_normal(len(x)), 4000)


def test_fingerprints_align():
    a, b, c = media.fingerprint(sound(1)), media.fingerprint(sound(1, start=8, noise=0.005)), media.fingerprint(sound(2))
    assert len(a) == (25000 - media.FRAME) // media.HOP + 1 - media.WIDTH + 1 and a.dtype == np.uint32
    found = media.align([a], [b, c, a])
    assert {f[1] for f in found} == {0, 2}
    by = {f[1]: f for f in found}
    assert abs(by[0][2] - 4000 / media.HOP) <= 1 and by[2][2] == 0 and by[2][5] == 0
    # the offset histogram by definition
    for i, j, offset, votes, *_ in found:
        other = [a, b, c, a][j + 1] if j < 2 else a
        hist = {}
        for p, x in enumerate(a):
            for q, y in enumerate(other):
                if x == y:
                    hist[p - q] = hist.get(p - q, 0) + 1
        assert votes == max(hist.values()) == hist[offset]


def test_integral_image_filters():
    image = np.random.default_rng(0).random((30, 12))
    got = media.integers(image)
    for t in (0, 7, len(got) - 1):
        bits = 0
        for kind, y, h, w in media.FILTERS:
            box = image[t : t + w, y : y + h]
            mid_t, mid_y = w // 2, h // 2
            a = {0: box[mid_t:].sum(), 1: box[:, mid_y:].sum(), 2: box[:mid_t, :mid_y].sum() + box[mid_t:, mid_y:].sum(), 3: box[:, h // 3 : h - h // 3].sum()}[kind]
            value = np.log1p(a) - np.log1p(box.sum() - a)
            bits = bits * 4 + [0, 1, 3, 2][sum(value >= v for v in media.BOUNDS)]
        assert bits == got[t]


def test_odd_audio():
    for x in (None, b"", b"RIFF", b"RIFF0000WAVEdata", sound(1)[:60], media.wav(np.zeros(100), 8000)):
        assert len(media.fingerprint(x)) == 0
    stereo = media.wav(np.zeros(4), 8000)
    assert media.pcm(stereo)[1] == 8000
    silence = media.integers(media.chroma(np.zeros(20000), 4000))
    assert len(silence) and (silence == media.SILENCE).all() and media.align([silence], [silence]) == []


def test_long_recordings_align():
    """A cut from beyond 2^20 frames is found, with its offset, beside another recording."""
    rng = np.random.default_rng(9)
    long, other = rng.integers(0, 2**32, 1_300_000, dtype=np.uint32), rng.integers(0, 2**32, 1000, dtype=np.uint32)
    cut = long[1_200_000:1_200_200]
    assert [f[:3] + f[4:] for f in media.align([long, other], [other, cut])] == [(0, 1, 1_200_000, 200, 0), (1, 0, 0, 1000, 0)]
    assert [f[:3] + f[4:] for f in media.align([cut], [other, long])] == [(0, 1, -1_200_000, 200, 0)]


def test_one_recording_at_two_rates():
    rng = np.random.default_rng(3)
    tune = rng.integers(-20, 12, 40)

    def play(rate):
        hz = np.repeat(440 * 2 ** (tune / 12), rate // 8)
        return media.wav(0.5 * np.sin(2 * np.pi * np.cumsum(hz) / rate), rate)

    low, high = media.fingerprint(play(8000)), media.fingerprint(play(44100))
    (found,) = media.align([low], [high])
    assert abs(found[2]) <= 1 and found[4] >= len(low) - 2


def test_common_integers_are_counted_whole(monkeypatch):
    """Votes by definition where many integers are equal and a group's pairs don't fit at once."""
    rng = np.random.default_rng(8)
    a, b = [rng.integers(0, 3, n).astype(np.uint32) for n in (40, 25, 60)], [rng.integers(0, 3, n).astype(np.uint32) for n in (50, 0, 30)]
    a[1][:20] = b[2][5:25]
    monkeypatch.setattr(media, "ERRORS", 1.0)
    whole = media.align(a, b)
    monkeypatch.setattr(media, "PAIRS", 100)
    assert media.align(a, b) == whole and len(whole) == 6
    for i, j, offset, votes, *_ in whole:
        hist = {}
        for p, x in enumerate(a[i]):
            for q, y in enumerate(b[j]):
                if x == y:
                    hist[p - q] = hist.get(p - q, 0) + 1
        assert votes == max(hist.values()) == hist[offset]


def test_matched_recordings(spark):
    from pyspark.sql import functions as F

    rows = [(0, sound(1)), (1, sound(2)), (7, sound(1)), (20, sound(1, start=6)), (21, None), (22, b""), (40, sound(3)), (41, sound(3)), (60, None)]
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "vec_id long, audio binary")
    got = {r.vec_id: r for r in media.matched(media.fingerprints(df, "vec_id", "audio"), "vec_id", F.col("vec_id") % 20 == 0).collect()}
    assert len(got) == len(rows) and got[7].class_id == 0 and got[41].class_id == 40 and got[21].class_id == 21
    assert got[0].match_id == 20 and got[20].match_id == 0 and got[0].n_links == 1 and got[40].n_links == 0 and got[60].n_links == 0 and got[1].n_links is None
    assert media.matched(media.fingerprints(df.limit(0), "vec_id", "audio"), "vec_id", F.col("vec_id") % 20 == 0).count() == 0


def test_search_finds_what_brute_force_finds(spark):
    """All queries against all recordings, pair by pair."""
    from pyspark.sql import functions as F

    df = media.recordings(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 200"))
    prints = {r.vec_id: np.frombuffer(bytes(r.print), np.uint32) for r in media.fingerprints(df, "vec_id", "audio").collect()}
    got = {r.vec_id: r.n_links for r in media.matched(media.fingerprints(df, "vec_id", "audio"), "vec_id", F.col("vec_id") % 20 == 0).collect()}
    for q in (k for k in prints if k % 20 == 0):
        others = [k for k in prints if prints[k].tobytes() != prints[q].tobytes()]
        want = {prints[k].tobytes() for k in others if media.align([prints[q]], [prints[k]])}
        assert got[q] == len(want)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, name):
    import duckdb

    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "labels"):
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries()[name](spark, sf).toPandas(), duck.sql(oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    form = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).map(lambda v: int(v) if isinstance(v, float) else v).to_numpy().tolist()))
    assert form(got) == form(want)


def test_pipeline(spark):
    import corpus_pipeline as C
    from pixloom.llm import bpe

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, seen = docs, {}
    for name, stage in C.STAGES:
        before, out = out, C.written(stage(spark, out, sf), name)
        seen[name] = (before, out)
        if name != "encode":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    assert 0 < len(ids(seen["quality"][1])) < docs.count()
    kept = ids(seen["near_duplicates"][1])
    assert len(kept) == len(set(kept)) and set(kept) <= set(ids(seen["quality"][1]))
    assert sorted(ids(seen["suffix_dedup"][1])) == sorted(kept)
    before, after = seen["encode"]
    ranks, pattern = bpe.vocabulary()
    codec = bpe.Codec(ranks, pattern)
    want = sorted((r.doc_id, len(codec.encode(r.text))) for r in before.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in after.collect()) == want
    assert C.run(spark, sf).count() == len(want)
