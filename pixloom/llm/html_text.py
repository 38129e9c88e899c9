"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks.  Every block is described by the word
counts and link densities of itself and of both neighbours, by its kind
(paragraph, heading or other), and, as one weak feature, by what the elements
around it are named.  A decision tree trained on the small labelled table below
keeps a block or drops it; names only refine what its first levels have split by
word counts, link densities and kinds.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed values of HTML: elements that begin and end a block, and elements whose content is no text: raw text, or elements in turn.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("noscript template select datalist button iframe object svg canvas audio video".split())
#: Elements, and words of class, id and role values, of a page's frame; and of the article.
FRAME_TAGS = frozenset("nav header footer aside form menu dialog head".split())
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs menu nav navbar navigation sidebar aside footer masthead topbar cookie cookies consent notice notices gdpr privacy popup modal comment comments commentlist reply replies respond disqus discussion login signup subscribe newsletter share sharing related recommended pagination pager copyright disclaimer complementary contentinfo alert".split()
)
#: Words that may stand beside a frame word in a name without changing what it says.
AROUND = frozenset("area bar bottom box block button buttons column container content group header holder inner items left links list main outer page panel policy post right row section site slot social text title top unit widget wrap wrapper".split())
#: Frame words that say what a name means when they stand last, whatever stands before them but MAYBE.
LAST_WORDS = frozenset("ads adverts advertisement comment comments commentlist replies cookies consent notice notices newsletter disclaimer".split())
MAYBE = frozenset("has hide is no show with without".split())
BODY_TAGS = frozenset(["article", "main"])
BODY_NAMES = frozenset("article article-body article-content content entry entry-content main main-content post post-body post-content story story-body".split())
PARAGRAPHS = frozenset("p blockquote pre li dd dt td th figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)*)(?:>|\Z)",  # quotes count after = only
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")

#: words and link density of the block before, of the block and of the one after; is a paragraph, is a heading; named as frame (-1) or article (1).
FEATURES = ("words_before", "links_before", "words", "links", "words_after", "links_after", "paragraph", "heading", "named")
#: Levels of the tree that don't look at names.
PLAIN_LEVELS = 2
#: A page a line, a block an item: * is main text, then words, L (all) or l (half) for links, p, h or d for the kind, + or - for names.
LABELLED = """
1Lp- 1Lp- 1Lp- 1Lp- 8d- *12h+ *60p+ *3p+ *45p+ *20p+ 14d-
1Lp- 1Lp- 1Lp- 6d- *12h+ *30p+ *25p+ *2p+ 9d-
1Lp- 1Lp- 2Lp- 12d- *9h+ *40p+ *12p+ *1p+ *70p+ 18d-
1Lp- 2Lp- 11d- *14h+ *16p+ *8p+ *5p+ 22d-
1Lp- 1Lp- 9d- *12h+ *120p+ 13d-
1Lp- 10d- *11h+ *4p+ 11d-
1Lp 1Lp 2Lp 1Lp *7h *45p *60p *5p *30p 3ld 2Ld 6d
2Lp 1Lp 8d *9h *35p *28p *3p *50p 12d
1Ld 1Ld *8h *50d *65d *40d 2Ld 5d
4h- 9p- 1Lp- 1Lp- *9h+ *40p+ *25p+ 20p- *55p+ *6p+ 4h- 18p- 30p- 12p- 3h- 5Lp- 6Lp- 10d-
5d- 14p- 1Lp- 1Lp- *6h+ *80p+ *5h+ *30p+ *22p+ 2h- 25p- 40p- 8p- 7d-
25d- 1Lp- 2Lp- *8h+ *70p+ *35p+ *12p+ *50p+ 8d-
22p- 2Ld- *10h *30p *45p *9p 6d
3h 2Lp 2Lp 1Lp *11h *33p *4h *27p *18p 3h 6Lp 5Lp 7Lp 9d
2h- 1Lp- 1Lp- *8h+ *15p+ *6p+ *9p+ *14p+ 2h- 4Lp- 6Lp- 12d-
1Lp- *5h+ *22p+ *6p+ *7p+ *5p+ *30p+ 16p- 9d-
1Lp- *5h+ *40p+ *30lp+ *12p+ *4Lp+ *25p+ 10d-
*10h *30p *40p
*20p *25p
*60d
*14d *20d *35d
1Lp 1Lp 1Lp 5Lp 4Lp 6Lp 3d
1Ld 2Ld 3Ld 7d
2Lp 5ld 4ld 3Ld 6ld
1Lp 3h 8Lp 12lp 7Lp 10lp 9Lp 8d
1Lp- 8p- *7h *90p *2h *45p *20p 28p- 35p- 12d-
12p- *9h+ *32p+ *41p+ 12p- *28p+ 6h- 15p- 12p- 21p-
1Lp- 45p- *10h+ *50p+ *60p+ 50p- 9d-
*8h+ *20p+ 8p- *35p+ 3p- *24p+
3d 5d *12h *45p *30p 4d 2d
*9h+ *6p+ *11p+ *8p+ *13p+ *7p+ *16p+ *10p+ *5p+ 12d-
*12p+ *14p+ *9p+ *18p+ *11p+ *3p+ *22p+ *6p+ *27p+ *8p+ *12p+ 9d-
*7h+ *28p+ *9p+ *12p+ *6p+ *2p+ *4p+ *1p+ *9p+ *33p+ *12p+ *5p+
*2h+ *1p+ *2p+ *1p+ *24p+ *1p+ *15p+ *2p+ *60p+ *1p+
*6d+ *12d+ *9d+ *30d+ *4d+ *3p+ *1d+
1Lp- 17d- *3h+ *5Lp+ *3Lp+ *18p+ *2Lp+ *7lp+ *40p+ *6Lp+ 30d-
1Lp- 5d- *1h+ *1p+ 3d-
1Lp- 3d- *4h+ *2p+ 28d-
1Lp- 1Lp- 24d- *2h+ *9p+ *8p+ 5d-
9d 12d 7d 11d 5d 8d
6h 5d 8d 12d 6d 9d
*14p *14p *14p *14p 2ld
*27p
*24p *18p *16p 6d
1Lp 1Lp 1Ld *5h *15p *18p *13p *33p *9p 1Lp 2Ld
1Lp 2Lp *3h *28p *45p *26p 1Lp 1Lp 1Lp
1Lp 1Lp *11h *60p *5h *30p *4h *75p 2Lp 1Lp
1Lp *8h *33p *70p *48p 2Lp 1Lp 1Lp
9p- 1Lp- *5h+ 22p- *40p+ *66p+ *31p+ *8p+ *2p+ 2h- 18p- 35p- 14d-
24p- 1Lp- 1Lp- *9h+ 6p- *28p+ *35p+ *12p+ 1h- 33p- 8p- 45d-
*4h+ 33p- *50p+ *44p+ *29p+ 2h- 12p- 28p- 37p-
*10h+ 14p- *77p+ *31p+ *1p+ 19p- 2h- 36p- 24p- 6p-
1Lp- 2Lp- *6h+ 38p- *27p+ *55p+ *13p+ *6p+ 1h- 6p- 9p- 38p-
*3h+ 3p- *26p+ *5h+ *70p+ 27p- 1h- 39p- 39p- 60d-
1Lp- 1Lp- 16p- 9p- 11p- 14p- 6p- 30p- 12p- 25p- 3p-
8h- 20p- 16p- 40p- 9p- 60p- 5p- 33p- 12d- 50d- 7d-
1Lp 1Lp 1Lp 7d *9h *26p *41p *17p 10d
1Lp 1Lp 2Lp 3Lp 12d *8h *19p *6p *37p *11p 8d
2Lp 1Lp 5d *4h *3p *44p *90p 13d
1Lp 1Lp 6d *7h *9p *150p *12p 4d
1Lp 2Lp 16d *11h *5p *8p *21p 26d
1Lp 4d *3h *62p 7d
1Ld 1Ld 2Ld 9d *10h *34p *2p *1p *23p 3d 2Ld
3d *6h *48p *31p 5d
3d *2h *15p *220p 11d
2d *13h *7p *27p 19d
1Lp 1Lp 11d *1h *36p *25p 9d
1Lp 2Lp 8d *5h *10p *13p *4p 6d
1Lp 1Lp 22d *2h *4p *2p *56p 14d
1Lp 14d *12h *1p *3p *80p *1p 8d
1Lp 2Lp 10d *6h *300p *140p 12d
2Lp 2Lp 13d *1h *2p *9p *30p *5p 5d
5Ld 3Ld 30d *9h *29p *33p 40d
18d *7h *51p *4h *28p *2h *73p *6p 12d 3d
34d *5h *16p *8p *20p 7d 2Ld 1Ld
7d 2Ld *8h *38p *3h *22p *47p 1Ld 1Ld 9d
2Lp 6d *14h *700p 10d
1Lp 9d *4h *1p 12d
1Lp 10d *8h *2p 6d
1Lp 8d *3h *12p 15d
4d *10h *95p *40p 24d 6d
*8h *44p *52p 5Lp 4Lp 6Lp 11d
*6h *18p *35p 2h 5Lp 7Lp 6Lp 8d
1Lp *5h *20p *64p 3h 8Lp 6Lp 9Lp 13d
1Lp 1Lp 1h 4Lp 5Lp *9h *40p *27p 6d
2h 1Ld 2Ld 1Ld *7h *33p *15p 3d
5d *9h *55d *38d *70d 10d
8d *6h *42d *3h *61d *29d 4d
3d 2Ld *11h *120d *90d 14d
*9h 3ld *45p *30lp *22p 3ld 4d
*7h 2d *25p *50p 3Ld 3Ld 5d
4d *8h 4d *31p *60p *14p 5ld 12d
1Lp 1Lp 7d *9h *28p *46p 3d 15d 2d 22d 8d
*10h *37p *19p 2d 12d 3d 9d 2d 28d
6d *5h *24p *66p *3h *1p *2p *17p 9d
1Lp 13d *9h *5p *6p *3p *8p *4p 7d
1Lp 1Lp 4d *8h *70p *1p *65p *3p *120p 12d
1Lp 1p 1Lp 2Lp 6d *9h *30p *14p *2p *41p 10d
2Lp 1Lp 2p *8h *25p *36p *1p *9p 8d
1Lp 2p 1Lp 1p 1Lp 7d *6h *3p *52p *2p *18p 12d
*7h *34p *21p 3h 6Lp 5p 7Lp 9d
1Ld 2d 1Ld *10h *27p *45p 5Lp 2p 4Lp
*5h *40p *3p 2Lp 1p 2Lp 11d
*16d *26d *44d *19d 5d
*13d *31d *52d
20p 1Ld *9h *33p *16p *48p 7d
1Lp 2Lp 18d *5h *29p *13p 6d
2Lp- 1Lp- 19d- *8h+ *21p+ *2p+ *43p+ 12d-
"""
ITEM = re.compile(r"(\*?)(\d+)([Ll]?)([phd])([+-]?)")


def described(found: list[tuple[int, float, bool, bool, int]]) -> list[tuple[float, ...]]:
    """FEATURES of each block of a page, from (words, link density, paragraph, heading, named) of all."""
    ends = (0, 0.0)
    out = []
    for k, (words, links, paragraph, heading, named) in enumerate(found):
        before, after = found[k - 1][:2] if k else ends, found[k + 1][:2] if k + 1 < len(found) else ends
        out.append((*before, words, links, *after, float(paragraph), float(heading), float(named)))
    return out


def labelled() -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for line in LABELLED.strip().splitlines():
        items = ITEM.findall(line)
        x += described([(int(n), {"": 0.0, "l": 0.5, "L": 1.0}[links], kind == "p", kind == "h", {"": 0, "+": 1, "-": -1}[named]) for _, n, links, kind, named in items])
        y += [int(star == "*") for star, *_ in items]
    return np.array(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, plain: int = PLAIN_LEVELS):
    """A decision tree by Gini impurity: a share of keeps, or (feature, threshold, below, above); the first `plain` levels don't see names."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(len(FEATURES) - (plain > 0)):  # of equally good splits the first
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < t
            gini = sum(part.sum() * (p := y[part].mean()) * (1 - p) for part in (low, ~low))
            if best is None or gini < best[0] - 1e-9:
                best = (gini, f, float(t), low)
    if best is None:
        return share
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1, plain - 1), grow(x[~low], y[~low], depth - 1, plain - 1)


@lru_cache(1)
def tree():
    return grow(*labelled())


def decide(node, row) -> bool:
    while isinstance(node, tuple):
        f, t, below, above = node
        node = below if row[f] < t else above
    return node >= 0.5


def _frame_name(name: str) -> bool:
    """Whether one class, id or role names a part of the frame: frame words, and nothing else but words that may stand around them; or a last word that says it alone."""
    words = WORDS.findall(name.lower())
    last = next((w for w in reversed(words) if w not in AROUND), "")
    if last in LAST_WORDS and words[0] not in MAYBE:
        return True
    return any(w in FRAME_WORDS for w in words) and all(w in FRAME_WORDS or w in AROUND for w in words)


def _mark(name: str, rest: str) -> int:
    """What an element is named as: frame (-1), article (1) or neither (0)."""
    if name in BODY_TAGS:
        return 1
    if name in FRAME_TAGS:
        return -1
    named = 0
    if "=" in rest and name not in ("html", "body"):
        for _, a, b, c in ATTRIBUTE.findall(rest):
            names = (a or b or c).split()
            if any(map(_frame_name, names)):
                return -1
            named = named or int(any(n.lower() in BODY_NAMES for n in names))
    return named


def blocks(html: str) -> list[tuple[str, float, bool, bool, int]]:
    """(text, link density, paragraph, heading, named) of the page's text blocks, in order.

    A block is named by the nearest element around it that is named as frame or
    article; inside a frame only a whole article element counts as article.
    """
    out, parts, at = [], [], 0
    stack: list[tuple[str, int]] = []  # open block elements and what their text is named as
    hidden: list[str] = []  # open elements from a hidden one inwards
    linked, href = 0, False

    def put(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text)
            parts.append(text)
            if href:
                linked += len(text.split())

    def close() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", "".join(parts)).strip()
            if text:
                kind, named = stack[-1] if stack else ("", 0)
                out.append((text, min(1.0, linked / len(text.split())), kind in PARAGRAPHS, kind in HEADINGS, named))
            parts.clear()
        linked = 0

    raw = None
    while at < len(html):
        if raw:
            end = re.compile(rf"</{raw}\s*/?>", re.I).search(html, at)
            at, raw = (end.end() if end else len(html)), None
            continue
        m = TOKEN.search(html, at)
        if not m:
            if not hidden:
                put(html[at:])
            break
        if not hidden:
            put(html[at : m.start()])
        at, name = m.end(), (m["name"] or "").lower()
        if not name:
            continue
        if hidden:
            if name in RAW:
                raw = None if m["end"] else name
                continue
            if not m["end"]:
                if name == hidden[0] and name in ("button", "select"):  # these never nest: a button ends the one before, select ends itself
                    hidden = [name] if name == "button" else []
                elif name not in VOID and not m["rest"].endswith("/"):
                    hidden.append(name)
                continue
            if name in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(name) :]
                continue
            if all(s[0] != name for s in stack):
                continue
            hidden = []  # its parent's end
        if name == "br":
            parts.append(" ")
        elif name in RAW:
            if not m["end"] and not m["rest"].endswith("/"):
                raw = name
        elif name in HIDDEN:
            if not m["end"] and not m["rest"].endswith("/"):
                hidden = [name]
        elif name == "a":
            href = not m["end"]
        elif name in BLOCKS or (not m["end"] and name not in VOID and "=" in m["rest"] and _mark(name, m["rest"]) < 0):
            close()
            if m["end"]:
                names = [s[0] for s in stack]
                if name in names:
                    del stack[len(names) - 1 - names[::-1].index(name) :]
            elif name not in VOID:
                if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
                named, over = _mark(name, m["rest"]), stack[-1][1] if stack else 0
                stack.append((name, over if not named or over < 0 and name not in BODY_TAGS else named))
                href = href and name not in ("div", "p", "article", "section", "nav", "footer")
        elif m["end"] and any(s[0] == name for s in stack):
            close()
            names = [s[0] for s in stack]
            del stack[len(names) - 1 - names[::-1].index(name) :]
    close()
    return out


def main_text(html: str | None, names: bool = True) -> str:
    """The kept blocks, joined by an empty line; empty for null, empty or text-free pages.  Without names, elements' names say nothing."""
    found = blocks(html or "")
    rows = described([(len(text.split()), links, paragraph, heading, named * names) for text, links, paragraph, heading, named in found])
    return "\n\n".join(b[0] for b, row in zip(found, rows, strict=True) if decide(tree(), row))


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages' id and url with text and n_chars (code points).

    Rows are kept one for one, repeated ones and those with null ids or urls
    too; null and empty html gives an empty text.  Other columns are not read.
    """
    small_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, "url")}

    def run(batches):
        for b in batches:
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=[id_col, "url", "text"])

    got = pages.select(id_col, "url", html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, url {kinds['url']}, text string")
    return got.withColumn("n_chars", F.length("text").cast("long"))


def op10_html(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page; odd rows as in `extracted`."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
