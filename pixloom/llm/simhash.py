"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Equal fingerprints collapse first.  The distinct ones are dealt to tiles of equal
size in the order of their population counts; tiles whose counts differ by more
than the radius can hold no link and are skipped.  The remaining tile pairs are
compared with exclusive-or and bit counts in numpy, sub-tile by sub-tile, again
skipping sub-tiles whose 16-bit parts' population counts (and, where texts must
be similar, numbers of shingles) are too far apart.  A tile pair returns a
spanning forest of its links, never all pairs, so a group of n near copies costs
O(n) rows.

`near_duplicates` links 64-bit fingerprints within a radius.  `keep_first` wants
similar texts: fingerprints of 192 bits with a radius that a similarity of 0.8
stays within gather candidates, and whole sets of shingles then decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AND_SPACE, grouped, keyed, one_of, partitions, small_batches, written
from .components import _find, _roots, components

#: Tiles that the fingerprints are dealt to, and the bounds of a tile's size; a task holds two tiles and their links.
TILES, LEAST_TILE, TILE = 48, 1024, 1 << 18
SUB, WIDE = 256, 2048
#: Near copies: words of a shingle, least similarity as a fraction.
WORDS, OVER, UNDER = 5, 4, 5
#: Bits of their fingerprints and the radius.  At a similarity of 0.8, 29 of 192 bits differ on average, with a
#: deviation of 5; two texts without a common shingle differ in 96 with a deviation of 7.
BITS, RADIUS = 192, 52
#: Members of a candidate group, and bytes of their sets, that are compared with as many others in one task.
CELL, CELL_BYTES = 1024, 16 << 20


def shingle_hashes(text: bytes | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words, repeats included; a text of fewer words is one shingle, one without words none."""
    found = (text or b"").translate(LOWER_AND_SPACE).split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: 1 - words or None].tolist(), end[words - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(start, end, strict=True)), np.uint64, len(start))


def _spread(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of each hash."""
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray, bits: int = 64) -> np.ndarray:
    """bits / 64 numbers whose bits are those that over half of the hashes (spread to that many bits) have."""
    n, counts = len(hashes), np.zeros(bits, np.int64)
    for at in range(0, n, 16384):
        part = hashes[at : at + 16384]
        wide = np.stack([part, *(_spread(part, k) for k in range(1, bits // 64))], axis=1) if bits > 64 else part
        counts += np.unpackbits(wide.view(np.uint8).reshape(len(part), bits // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of 64 bits over shingles of lower-cased words; 0 if there is no word (or text is None)."""
    return int(majority(shingle_hashes(text, words, seed))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fingerprint long) of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = np.fromiter((fingerprint(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint long")


def _joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Indices into links (i, j) of those that join what parent holds apart; parent is brought up to date."""
    root = _roots(parent)
    ri, rj = root[i], root[j]
    new = np.nonzero(ri != rj)[0]
    _, first = np.unique(np.minimum(ri, rj)[new] * len(parent) + np.maximum(ri, rj)[new], return_index=True)
    for n in new[first].tolist():
        x, y = _find(parent, i[n]), _find(parent, j[n])
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield n


def _parts(fp: np.ndarray) -> np.ndarray:
    """Population counts of a fingerprint's 16-bit parts."""
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16)).astype(np.int16)


def link_forest(a: np.ndarray, b: np.ndarray | None, radius: int, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) into a and b, one after another (or a, for None), of links that connect all that links within radius connect.

    a and b are (n, words) of 64-bit numbers.  With sizes (of both, one after
    another), links are between texts whose sizes allow a similarity of
    OVER / UNDER only.
    """
    same = b is None
    both = a if same else np.concatenate([a, b])
    size = np.zeros(len(both), np.int64) if sizes is None else sizes

    def sorted_(lo, hi):
        keys = _parts(both[lo:hi]).T if sizes is None else (size[lo:hi],)
        return lo + np.lexsort(keys)

    ids_a = sorted_(0, len(a))
    ids_b = ids_a if same else sorted_(len(a), len(both))
    xa, xb = both[ids_a], both[ids_b]

    def boxes(x, ids):
        q, at = _parts(x), np.arange(0, len(x), SUB)
        return [f.reduceat(v, at).astype(np.int64) for v in (q, size[ids]) for f in (np.minimum, np.maximum)]

    (lo_a, hi_a, small_a, large_a), (lo_b, hi_b, small_b, large_b) = boxes(xa, ids_a), boxes(xb, ids_b)
    parent, left, right = np.arange(len(both)), [], []
    for k in range(len(lo_a)):
        gap = np.maximum(0, np.maximum(lo_b - hi_a[k], lo_a[k] - hi_b)).sum(axis=1)
        near = np.nonzero((gap <= radius) & (UNDER * large_a[k] >= OVER * small_b) & (UNDER * large_b >= OVER * small_a[k]))[0]
        if same:
            near = near[near >= k]
        rows = xa[k * SUB : (k + 1) * SUB]
        for at in range(0, len(near), WIDE // SUB):
            where = np.concatenate([np.arange(n * SUB, min((n + 1) * SUB, len(xb))) for n in near[at : at + WIDE // SUB]])
            others = xb[where]
            apart = sum(np.bitwise_count(rows[:, None, w] ^ others[None, :, w]) for w in range(both.shape[1]))
            i, j = np.nonzero(apart <= radius)
            i, j = ids_a[i + k * SUB], ids_b[where[j]]
            if sizes is not None and len(i):
                fits = UNDER * np.minimum(size[i], size[j]) >= OVER * np.maximum(size[i], size[j])
                i, j = i[fits], j[fits]
            if len(i):
                found = list(_joined(parent, i, j))
                left += i[found].tolist()
                right += j[found].tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): nodes that connect all fingerprints within radius bits.

    prints has each fingerprint once: (node long, w0, w1, ... long) and, where
    texts must be similar in size, `size`.
    """
    spark = prints.sparkSession
    words = sorted(c for c in prints.columns if c[0] == "w")
    bits, sized = 64 * len(words), "size" in prints.columns
    if bits >= 256:
        raise ValueError("a fingerprint has at most 192 bits")
    prints = prints.withColumn("ones", sum(F.bit_count(c) for c in words)).withColumn("size", F.col("size").cast("int") if sized else F.lit(0))
    count = {r.ones: r.n for r in prints.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # bits + 1 rows at most
    before = np.concatenate([[0], np.cumsum([count.get(p, 0) for p in range(bits + 1)])]).tolist()
    per = max(LEAST_TILE, min(TILE, -(-before[-1] // TILES)))
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    # a fingerprint's place in the order of population counts, by a hash among those with its count
    place = pick(before, F.col("ones")) + F.pmod(F.xxhash64(*words), pick([max(1, count.get(p, 0)) for p in range(bits + 1)], F.col("ones")))
    tiles = prints.withColumn("tile", F.floor(place / per).cast("int"))
    columns = ("node", "size", *words)

    def pack(key, table):
        ones = table.column("ones").to_numpy()
        cells = [pa.array([np.ascontiguousarray(table.column(c).to_numpy()).tobytes()], pa.binary()) for c in columns]
        ends = [pa.array([x], pa.int32()) for x in (key[0].as_py(), ones.min(), ones.max())]
        return pa.Table.from_arrays([*ends, *cells], names=["tile", "low", "high", *columns])

    packed = tiles.select("tile", "ones", *columns).groupBy("tile").applyInArrow(pack, "tile int, low int, high int, " + ", ".join(f"{c} binary" for c in columns))
    first = F.floor(pick(before, F.greatest(F.col("low") - radius, F.lit(0))) / per).cast("int")
    last = F.floor((pick(before, F.least(F.col("high") + radius, F.lit(bits)) + 1) - 1) / per).cast("int")
    pairs = packed.withColumn("other", F.explode(F.sequence(first, last))).select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", *columns)
    types = {"size": np.int32, "node": np.int64}

    def compare(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["tile"])
        if len(rows) == 1 and table.column("a")[0] != table.column("b")[0]:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        node, size = (np.concatenate([np.frombuffer(r[c], types[c]) for r in rows]) for c in ("node", "size"))
        fp = [np.stack([np.frombuffer(r[c], np.uint64) for c in words], axis=1) for r in rows]
        i, j = link_forest(fp[0], fp[1] if len(fp) > 1 else None, radius, size.astype(np.int64) if sized else None)
        return pa.table({"a": node[i], "b": node[j]})

    return pairs.repartition(partitions(spark), "a", "b").groupBy("a", "b").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint long, component_id) of every row of docs; ids may be of any type that has an order.

    component_id is the smallest id reachable over links of at most radius
    differing bits, the row's own included.  A null text counts as empty and
    has fingerprint 0 like any text without words; such rows link with each
    other.  Rows without an id link like others; a component without any id has
    a null component_id.  Repeated rows are kept, each with its component.
    """
    prints = fingerprints(docs, id_col, text_col, words)
    salt = F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(partitions(docs.sparkSession))).cast("int"), F.lit(0))
    prints = written(prints.withColumn("_salt", salt), "prints")
    # a fingerprint's rows are counted and joined by (fingerprint, salt), so that a common one is spread over all tasks
    parts = prints.groupBy("fingerprint", "_salt").agg(F.min(id_col).alias("rep"))
    distinct = written(parts.groupBy("fingerprint").agg(F.min("rep").alias("rep"), F.collect_list("_salt").alias("salts")), "distinct")
    found = components(written(links(distinct.select(F.col("fingerprint").alias("node"), F.col("fingerprint").alias("w0")), radius), "links"))
    of = distinct.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "rep", F.coalesce("component", "fingerprint").alias("c"))
    least = grouped(of, "c", ["fingerprint"], [F.min("rep").alias("m")], [F.min("m").alias("component_id")]).select("fingerprint", "component_id")
    told = distinct.select("fingerprint", F.explode("salts").alias("_salt")).join(least, "fingerprint")
    return prints.join(told, ["fingerprint", "_salt"]).select(id_col, "fingerprint", "component_id")


# --- similar texts ----------------------------------------------------------------


def node_of(found: np.ndarray) -> int:
    """A set's number."""
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes())], np.uint64).view(np.int64)[0])


def similar_forest(sets: list[np.ndarray], cut: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of pairs with a Jaccard similarity of OVER / UNDER that connect all that such pairs connect.

    With cut, pairs are between sets before it and sets from it on.  Counts the
    shared shingles of one set with all others at once, over lists of the sets
    that hold a shingle.
    """
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    value, own = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(n), size)
    by = np.argsort(value, kind="stable")
    value, own = value[by], own[by]
    head = np.nonzero(np.r_[True, value[1:] != value[:-1]])[0] if len(value) else np.zeros(0, np.int64)
    many = np.diff(np.r_[head, len(value)])
    group = np.repeat(np.arange(len(head)), many)
    mine = np.argsort(own, kind="stable")  # a set's places in value
    start = np.r_[0, np.cumsum(size)]
    parent, left, right = np.arange(n), [], []
    for a in range(n if cut is None else cut):
        g = group[mine[start[a] : start[a + 1]]]
        g = g[many[g] > 1]
        if len(g):
            length = many[g]
            at = np.repeat(head[g] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            both = np.bincount(own[at], minlength=n)
            ok = (UNDER * both >= OVER * (size[a] + size - both)) & (both > 0)
            ok[: a + 1 if cut is None else cut] = False
            j = np.nonzero(ok)[0]
            i = np.full(len(j), a)
            found = list(_joined(parent, i, j))
            left += i[found].tolist()
            right += j[found].tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def celled(near: DataFrame) -> DataFrame:
    """near (component, node, size: numbers of a set) with the cells that its component's sets are dealt to."""
    part = [F.count("*").alias("n"), F.sum("size").alias("numbers")]
    count = F.greatest(F.ceil(F.sum("n") / CELL), F.ceil(F.sum("numbers") * 8 / CELL_BYTES)).cast("int")
    return grouped(near, "component", ["node"], part, [count.alias("cells")])


def confirmed(members: DataFrame) -> DataFrame:
    """(a, b): nodes of similar sets that connect all that similar sets connect; members is (node, component, cells, found: bytes of the set).

    A component's members are dealt to cells by a hash of the node, so that a
    task compares two cells, however large the component is.
    """
    dealt = members.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    pairs = dealt.select("component", F.least("cell", "other").alias("x"), F.greatest("cell", "other").alias("y"), "cell", "node", "found")

    def compare(table):
        cell = table.column("cell").to_numpy()
        by = np.argsort(cell, kind="stable")
        node, found = table.column("node").to_numpy()[by], table.column("found").to_pylist()
        lone = table.column("x")[0] == table.column("y")[0]
        i, j = similar_forest([np.frombuffer(found[k], np.uint64) for k in by], None if lone else int((cell == cell.min()).sum()))
        return pa.table({"a": node[i], "b": node[j]})

    return pairs.repartition(partitions(members.sparkSession), "component", "x", "y").groupBy("component", "x", "y").applyInArrow(compare, "a long, b long")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id.

    Near copies have sets of five-word shingles with a Jaccard similarity of 0.8
    or more, directly or over others.  Rows without an id come after those with
    one; of equal ids the text's digest decides, and of equal rows one stays.
    Texts without words (null, empty, white space) are copies of each other.
    An empty table stays empty; further columns ride along.
    """
    small_batches(docs.sparkSession)
    kind, words = docs.schema["doc_id"].dataType.simpleString(), [f"w{k}" for k in range(BITS // 64)]

    def heads(batches):
        for b in batches:
            found = [np.unique(shingle_hashes(t, WORDS)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            wide = np.array([majority(f, BITS) for f in found], np.uint64).reshape(-1, len(words)).view(np.int64)
            columns = [pa.array([node_of(f) for f in found], pa.int64()), pa.array(list(map(len, found)), pa.int32()), *(pa.array(np.ascontiguousarray(wide[:, k])) for k in range(len(words)))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["row", "node", "size", *words])

    form = f"row struct<doc_id:{kind},digest:bigint>, node long, size int, " + ", ".join(f"{w} long" for w in words)
    rows = written(keyed(docs).mapInArrow(heads, form), "rows")
    key = F.struct(F.col("row.doc_id").isNull().alias("none"), "row.doc_id", "row.digest")
    distinct = rows.groupBy("node").agg(F.min(key).alias("k"), *(F.first(c).alias(c) for c in ("size", *words)))
    distinct = written(distinct, "distinct")
    near = components(written(links(distinct.select("node", "size", *words), RADIUS), "links"))

    def whole(batches):
        for b in batches:
            found = [np.unique(shingle_hashes(t, WORDS)).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "component", "cells")), pa.array(found, pa.binary())], names=["node", "component", "cells", "found"])

    # one row's text for each set that has candidates
    cells = celled(near.join(distinct.select("node", "size"), "node").select("component", "node", "size"))
    asked = distinct.select("node", "k").join(cells, "node").select("k.doc_id", "k.digest", "node", "component", "cells")
    texts = keyed(docs).select("row.doc_id", "row.digest", "text")
    same = F.col("t.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("t.digest") == F.col("k.digest"))
    members = texts.alias("t").join(asked.alias("k"), same).select("k.node", "k.component", "k.cells", "t.text").mapInArrow(whole, "node long, component long, cells int, found binary")
    members = written(members.dropDuplicates(["node"]), "members")
    linked = components(written(confirmed(members), "confirmed"))
    of = distinct.select("node", "k").join(linked, "node", "left").withColumn("c", F.coalesce("component", "node"))
    first = of.groupBy("c").agg(F.min("k").alias("k")).select("k.doc_id", "k.digest")
    return one_of(docs, written(first, "first"), rows.select("row.doc_id", "row.digest"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document; odd rows as in `near_duplicates`."""
    from .common import documents

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
