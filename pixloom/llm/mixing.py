"""Mixing sources to target weights with soft membership, in DataFrame functions only.

A naive Bayes classifier fitted on the labelled table gives every document a
posterior over domains.  Document rates r >= 0 are then fitted by projected
gradient least squares so that the expected tokens of each domain,
sum(rate * tokens * posterior), meet the targets: every round is one aggregate
of as many sums as there are domains, and the step is the same small expression
for every document, so rates never leave the executors.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written

DOMAINS = ("good", "low", "toxic")
#: Shares of expected tokens.
TARGETS = {"good": 0.92, "low": 0.04, "toxic": 0.04}
#: Labelled documents that the classifier is fitted on (expected; chosen by a hash of the id), and words it may use.
LABELLED, WORDS = 4000, 256
#: Most rounds, share of the tokens that a domain may be off its target by, and weak pull to rate 1.
ROUNDS, OFF, PULL = 40, 1e-4, 1e-6
#: Shares of a text's characters (SQL for their number) and the bounds of their bins; "spread" is the share of different words.
#: replace and regexp_count cost a few nanoseconds a byte, translate looks every character up in a map.
BINS = (
    ("symbols", "regexp_count(text, '[#*$%&<>]')", (0.001, 0.02, 0.06)), ("bars", "length(text) - length(replace(text, '|', ''))", (0.001, 0.02)),
    ("shouts", "length(text) - length(replace(text, '!', ''))", (0.001, 0.02, 0.06)), ("spread", None, (0.1, 0.25)),
)


def _described(docs: DataFrame) -> DataFrame:
    """docs (id, text) with words (lower case, cut at white space, commas and full stops), n_tokens and a bin column for each of BINS."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("words", F.split(F.lower("text"), r"[ \t-\r.,]+"))
    shares = {f"share_{name}": (F.expr(count) if count else F.size(F.array_distinct("words"))) / F.greatest(F.length("text") if count else F.size("words"), F.lit(1)) for name, count, _ in BINS}
    df = df.withColumns(shares | {"n_tokens": F.size(F.array_remove("words", "")).cast("long")})
    bins = {f"bin_{name}": sum(((F.col(f"share_{name}") > b).cast("int") for b in bounds), F.lit(0)) for name, _, bounds in BINS}
    return df.withColumns(bins).drop("text", *shares)


def _adding(weight):
    return lambda a, w: a + F.coalesce(F.try_element_at(weight, w), F.lit(0.0))


def domain_sql() -> str:
    return "case when toxic = 1 then 'toxic' when quality = 1 then 'good' else 'low' end"


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Log priors, log likelihoods of bins and log ratios of words by domain, from at most about LABELLED labelled documents."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(0))).alias("quality"))
    n = known.count()
    share = min(1.0, LABELLED / max(1, n))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("doc_id", F.expr(domain_sql()).alias("domain"))
    table = _described(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))  # known has LABELLED rows
    table = written(table, "labelled")
    total = {r.domain: r.n for r in table.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    everyone = sum(total.values())
    model: dict = {"prior": {d: math.log((total.get(d, 0) + 1) / (everyone + len(DOMAINS))) for d in DOMAINS}, "bins": {}, "words": {}}
    cells = [(name, b) for name, _, bounds in BINS for b in range(len(bounds) + 1)]
    got = {r.domain: r for r in table.groupBy("domain").agg(*(F.count_if(F.col(f"bin_{name}") == b).alias(f"{name}_{b}") for name, b in cells)).collect()}
    for name, _, bounds in BINS:
        seen = {d: [got[d][f"{name}_{b}"] if d in got else 0 for b in range(len(bounds) + 1)] for d in DOMAINS}
        model["bins"][name] = {d: [math.log((k + 0.5) / (total.get(d, 0) + 0.5 * len(v))) for k in v] for d, v in seen.items()}
    rate = lambda d, base: f"(count_if(domain = '{d}') + {base}) / {total.get(d, 0) + 1}"
    by = table.select("domain", F.explode(F.array_distinct("words")).alias("w")).where("w <> ''").groupBy("w")
    rows = by.agg(F.count("*").alias("n"), *(F.expr(f"ln({rate(d, '0.5 * count(*) / ' + str(everyone + 1))})").alias(d) for d in DOMAINS), *(F.expr(f"abs(count_if(domain = '{d}') - count(*) * {total.get(d, 0) / max(1, everyone)}) / sqrt(count(*) * {max(1e-6, total.get(d, 0) / max(1, everyone) * (1 - total.get(d, 0) / max(1, everyone)))})").alias(f"z_{d}") for d in DOMAINS))
    z = F.greatest(*(F.col(f"z_{d}") for d in DOMAINS))
    for r in rows.where((F.col("n") >= 5) & (z > 5)).orderBy(z.desc(), "w").limit(WORDS).collect():
        mean = sum(r[d] for d in DOMAINS) / len(DOMAINS)
        model["words"][r.w] = {d: r[d] - mean for d in DOMAINS}
    # a text without any word that speaks for a domain says something too
    by_domain = _speaking(model["words"])
    has = {s: F.count_if(F.arrays_overlap("words", F.array(*map(F.lit, words)))).alias(s) for s, words in by_domain.items()}
    got = {r.domain: r for r in table.groupBy("domain").agg(F.count("*").alias("n"), *has.values()).collect()}
    model["some"] = {s: {d: ((got[d][s] if d in got else 0) + 0.5) / (total.get(d, 0) + 1) for d in DOMAINS} for s in has}
    return model


def _speaking(words: dict) -> dict[str, list[str]]:
    """The words by the domain that they speak for most."""
    out: dict[str, list[str]] = {}
    for w, v in words.items():
        out.setdefault(max(DOMAINS, key=lambda d: v[d]), []).append(w)
    return out


def posteriors(docs: DataFrame, model: dict, rest: tuple = ()) -> DataFrame:
    """(doc_id, digest of the text, n_tokens, p_<domain>, rest) of every row."""
    df = _described(docs.select("doc_id", "text", F.xxhash64("text").alias("digest"), *rest))
    words, by = model["words"], _speaking(model["words"])
    if words:
        df = df.withColumn("hits", F.array_intersect("words", F.array(*map(F.lit, words))))
    for d in DOMAINS:
        score = F.lit(model["prior"][d])
        for name, logs in model["bins"].items():
            score = score + F.element_at(F.array(*map(F.lit, logs[d])), F.col(f"bin_{name}") + 1)
        if words:
            weight = F.create_map(*(F.lit(x) for w, v in words.items() for x in (w, v[d])))
            score = score + F.aggregate("hits", F.lit(0.0), _adding(weight))
        for speaks, share in model["some"].items():
            found = F.arrays_overlap("hits", F.array(*map(F.lit, by[speaks])))
            score = score + F.when(found, math.log(share[d])).otherwise(math.log(1 - share[d]))
        df = df.withColumn(f"s_{d}", score)
    top = F.greatest(*(F.col(f"s_{d}") for d in DOMAINS))
    df = df.withColumns({f"e_{d}": F.exp(F.col(f"s_{d}") - top) for d in DOMAINS})
    norm = sum((F.col(f"e_{d}") for d in DOMAINS), F.lit(0.0))
    return df.select("doc_id", "digest", "n_tokens", *((F.col(f"e_{d}") / norm).alias(f"p_{d}") for d in DOMAINS), *rest)


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """x of matrix x = right, for a few domains, by elimination with pivots."""
    n, rows = len(right), [[*m, r] for m, r in zip(matrix, right, strict=True)]
    for k in range(n):
        top = max(range(k, n), key=lambda i: abs(rows[i][k]))
        rows[k], rows[top] = rows[top], rows[k]
        for i in range(n):
            if i != k and rows[k][k]:
                share = rows[i][k] / rows[k][k]
                rows[i] = [a - share * b for a, b in zip(rows[i], rows[k], strict=True)]
    return [rows[k][n] / rows[k][k] if rows[k][k] else 0.0 for k in range(n)]


def rates(table: DataFrame, targets: dict[str, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """table (n_tokens, p_<domain>) with rate: projected gradient least squares from rate 1.

    Minimises the squares of (expected tokens - target) by domain, with a weak
    pull to rate 1, over rates >= 0.  Targets are shares of the tokens that
    there are.  A document's gradient is its posteriors times the domains'
    errors; these are scaled by the curvature that the documents with a rate
    above 0 give (a small matrix, summed in the same pass), so that few rounds
    are needed.  Ends when every domain is within OFF of its target, when four
    rounds bring nothing, or after `rounds`; the share that is left is logged.
    Documents without tokens have no say in the sums.
    """
    targets = targets or TARGETS
    names = list(targets)
    p = {d: F.col(f"p_{d}") for d in names}
    cells = [(a, b) for i, a in enumerate(names) for b in names[i:]]

    def seen(rate):
        tokens = rate * F.col("n_tokens")
        curve = (F.sum(F.when(rate > 0, F.col("n_tokens") * p[a] * p[b]).otherwise(0.0)).alias(f"h_{a}_{b}") for a, b in cells)
        return table.agg(*(F.sum(tokens * p[d]).alias(d) for d in names), *curve).first()

    rate = F.lit(1.0)
    now = seen(rate)
    total = sum(now[d] or 0.0 for d in names)
    if not total:
        return table.withColumn("rate", rate)
    best, kept, since = math.inf, rate, 0
    for _ in range(rounds + 1):
        error = [now[d] / total - targets[d] for d in names]
        off = max(map(abs, error))
        since = 0 if off < 0.99 * best else since + 1
        if off < best:
            best, kept = off, rate
        if best <= OFF or since == 4:
            break
        h = [[now[f"h_{min(a, b, key=names.index)}_{max(a, b, key=names.index)}"] / total + 1e-4 * (a == b) for b in names] for a in names]
        step = sum((p[d] * F.lit(-x) for d, x in zip(names, _solved(h, error), strict=True)), rate * (1 - PULL) + PULL)
        rate = F.greatest(F.lit(0.0), step)
        now = seen(rate)
    logging.getLogger(__name__).info("domains are within %.5f of their targets", best)
    return table.withColumn("rate", kept)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, rest: tuple = ()) -> DataFrame:
    """(doc_id, digest, n_tokens, p_<domain>, rest, rate, copies) of every row of docs; rest are columns that ride along.

    copies is the whole part of rate, and one more with its fraction as
    probability, drawn by a hash of the id (of the text, for
    rows without one), so that a rerun gives the same.
    Null and empty texts have no tokens; labels may be empty (posteriors are then
    the priors) and may repeat a document (its worst label counts).
    """
    table = written(posteriors(docs, fit(docs, labels), rest), "posteriors")
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", F.lit("copies"))).otherwise(F.xxhash64("doc_id", F.lit("copies")))
    draw = F.pmod(drawn, F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("rate")
    return rates(table, targets).withColumn("copies", (whole + (draw < F.col("rate") - whole).cast("long")).cast("long"))


def remix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with each row as often as its copies say (not at all for 0).

    Rows are rated one by one and carry their columns along, with an id or
    without: nothing is joined or shuffled.  Of repeated rows each is rated.
    """
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    copies = mixed(whole, labels, targets, ("_row",)).where("copies > 0")
    return copies.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Tokens, posteriors, rate and copies of every document; odd rows as in `mixed`."""
    found = mixed(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_tokens", *(F.round(f"p_{d}", 6).alias(f"p_{d}") for d in DOMAINS), F.round("rate", 6).alias("rate"), "copies")
