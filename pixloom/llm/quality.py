"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good (1) where its measure is plainly normal, bad (-1) where it
is plainly not, and abstains (0) between.  The votes of all documents are counted
by vote pattern (at most 3^rules rows, whatever the input), and
expectation-maximisation over those counts estimates, for good documents and for
a few kinds of bad ones, their share and how often each rule votes either way on
them; a rule's accuracy follows from these.  Kinds are needed because faults
exclude each other: to one class of all bad documents a fault that comes alone
looks like noise.  A kind is known by several rules, none of which decides: a
document with one bad vote that the kind's other rules contradict is kept, and
one on which several rules abstain may go without any bad vote.  The posterior
probability of being good replaces all-must-pass filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: SYMBOLS and further marks that prose has few of; words of nothing but ASCII punctuation.
MARKS = SYMBOLS + "!@^~_=+{}[]\\"
BARE = r"^[!-/:-@\[-`{-~]+$"
#: (rule, SQL for a bad vote, SQL for a good vote); a rule with neither abstains.
RULES = (
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols < 0.02 * n_words"),
    ("marks", "n_marks > 0.05 * word_chars", "n_marks < 0.015 * word_chars"),
    ("bare", "n_bare > 0.1 * n_words", "n_bare < 0.02 * n_words"),
    ("shouting", "n_upper > 0.3 * word_chars", "n_upper < 0.12 * word_chars"),
    ("exclaiming", "n_exclaim > 0.2 * n_words", "n_exclaim < 0.03 * n_words"),
    ("word_length", "word_chars > 10 * n_words or word_chars < 3 * n_words", "word_chars > 3.7 * n_words and word_chars < 8 * n_words"),
    ("repeated_lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.02 * n_lines"),
    ("repeated_words", "n_repeat_words > 0.1 * n_words", "n_repeat_words < 0.02 * n_words"),
    ("variety", "n_distinct * 4 < n_words", "n_distinct > 0.5 * n_words"),
    ("stutter", "n_again > 0.1 * n_words", "n_again < 0.03 * n_words"),
    ("sentences", "n_stops * 80 < n_words or n_stops * 2 > n_words", "n_stops * 60 >= n_words and n_stops * 3 < n_words"),
)
#: Kinds of bad documents, each with the rules that speak of it.
KINDS = {
    "junk": ("symbols", "marks", "bare"), "shouted": ("shouting", "exclaiming", "marks"),
    "repetition": ("repeated_lines", "repeated_words", "variety", "stutter"), "odd": ("word_length", "sentences", "variety"),
}
ROUNDS = 15
#: Pseudo-counts as a share of all documents: what the rates start from and are drawn to.
PRIOR = 0.02
START_GOOD = 0.85
#: Start rates of bad and good votes: on good documents, of a kind's own rules on that kind, of other rules on it.
START = {"good": (0.02, 0.85), "own": (0.6, 0.2), "other": (0.05, 0.7)}
CLASSES = ("good", *KINDS)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_distinct", "n_stops", "n_marks", "n_bare", "n_again")


def _less(column: str, chars: str):
    """How many of chars the column holds."""
    return F.length(column) - F.length(F.translate(column, chars, ""))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, FEATURES as longs) of every row; a null text counts as empty."""
    df = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("t"))
    df = df.withColumn("s", F.btrim("t", F.lit(SPACE)))
    df = df.select(id_col, "t", "s", F.when(F.col("s") == "", F.array().cast("array<string>")).otherwise(F.split("s", r"[\x20\x09-\x0D]+")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = df.select(
        id_col, "w", lines.alias("lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("wh"), F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"), _less("t", SYMBOLS).cast("long").alias("n_symbols"),
        _less("t", UPPER).cast("long").alias("n_upper"), _less("t", "!").cast("long").alias("n_exclaim"), _less("t", ".!?").cast("long").alias("n_stops"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>!@^~_=+{}\[\]\\]")).cast("long").alias("n_marks"), F.size(F.filter("w", lambda x: x.rlike(BARE))).cast("long").alias("n_bare"),
    )
    five = F.transform(F.sequence(F.lit(1), F.size("wh") - 4), lambda i: F.xxhash64(*(F.element_at("wh", i + k) for k in range(5))))
    df = df.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_upper", "n_exclaim", "n_stops", "n_marks", "n_bare", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size(F.array_distinct("wh")).cast("long").alias("n_distinct"),
        F.size(F.filter("wh", lambda h, i: h == F.get("wh", i - 1))).cast("long").alias("n_again"),
        F.when(F.size("wh") >= 5, five).otherwise(F.array().cast("array<bigint>")).alias("five"),
    )
    again = F.size("five") > F.size(F.array_distinct("five"))
    df = df.withColumn("sorted", F.when(again, F.sort_array(F.transform("five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    h = lambda j: F.get("sorted", j)["h"]
    twice = F.filter("sorted", lambda e, j: (e["h"] == h(j - 1)) | (e["h"] == h(j + 1)))
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
    covered = F.aggregate("at", zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).select(id_col, *FEATURES)


def votes(table: DataFrame) -> DataFrame:
    """table of features with a column v_<rule> of -1, 0 or 1 for each rule."""
    return table.withColumns({f"v_{name}": F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for name, bad, good in RULES})


def start() -> dict:
    """Shares s_<class>, and rates n_<class>_<rule> of bad votes and p_<class>_<rule> of good ones."""
    out = {}
    for c in CLASSES:
        out[f"s_{c}"] = START_GOOD if c == "good" else (1 - START_GOOD) / len(KINDS)
        for name, _, _ in RULES:
            out[f"n_{c}_{name}"], out[f"p_{c}_{name}"] = START["good" if c == "good" else "own" if name in KINDS[c] else "other"]
    return out


def weight_sql(theta: dict, c: str) -> str:
    """P(class and votes) under theta, whose values are numbers or SQL."""
    logs = [f"ln({theta[f's_{c}']})"]
    for name, _, _ in RULES:
        n, p = theta[f"n_{c}_{name}"], theta[f"p_{c}_{name}"]
        logs.append(f"case v_{name} when 1 then ln({p}) when -1 then ln({n}) else ln(greatest(1 - {n} - {p}, 0.0001)) end")
    return f"exp({' + '.join(logs)})"


def posterior_sql(theta: dict) -> str:
    """P(good | votes)."""
    good = weight_sql(theta, "good")
    return f"{good} / ({good} + {' + '.join(weight_sql(theta, c) for c in CLASSES[1:])})"


def step_sql() -> dict[str, str]:
    """The next theta's expressions, as aggregates over patterns with a count n and class weights w_<class>."""
    clip = lambda x: f"least(0.9999, greatest(0.0001, {x}))"
    first, total = start(), " + ".join(f"w_{c}" for c in CLASSES)
    out = {}
    for c in CLASSES:
        mine, prior = f"n * w_{c} / ({total})", f"{PRIOR * first[f's_{c}']} * sum(n)"
        out[f"s_{c}"] = clip(f"(sum({mine}) + {prior}) / ({1 + PRIOR} * sum(n))")
        for name, _, _ in RULES:
            for k, vote in (("n", -1), ("p", 1)):
                out[f"{k}_{c}_{name}"] = clip(f"(sum(case when v_{name} = {vote} then {mine} else 0 end) + {prior} * {first[f'{k}_{c}_{name}']}) / (sum({mine}) + {prior})")
    return out


def accuracies(theta: dict) -> dict[str, float]:
    """How often each rule's vote is right, where it votes."""
    out = {}
    for name, _, _ in RULES:
        bad = {k: sum(theta[f"s_{c}"] * theta[f"{k}_{c}_{name}"] for c in CLASSES[1:]) for k in "np"}
        good = {k: theta["s_good"] * theta[f"{k}_good_{name}"] for k in "np"}
        out[name] = (good["p"] + bad["n"]) / (sum(good.values()) + sum(bad.values()))
    return out


def _sql(values) -> str:
    """A literal of nested lists of numbers."""
    return f"array({', '.join(map(_sql, values))})" if isinstance(values, list) else f"{float(values)!r}D"


def rounds_sql(rounds: int) -> str:
    """All rounds as one expression over pats, an array of (n, v: votes by rule), and total, the sum of n.

    The state is (s, n, p) by class and rule.
    transform(array(x), y -> ...)[0] names x.
    """
    t, names = start(), [name for name, _, _ in RULES]
    s0 = [t[f"s_{c}"] for c in CLASSES]
    n0, p0 = ([[t[f"{k}_{c}_{j}"] for j in names] for c in CLASSES] for k in "np")
    classes, rules = f"sequence(0, {len(CLASSES) - 1})", f"sequence(0, {len(names) - 1})"
    clip = lambda x: f"least(0.9999D, greatest(0.0001D, {x}))"
    vote = "ln(case e.v[j] when -1 then th.n[c][j] when 1 then th.p[c][j] else greatest(1 - th.n[c][j] - th.p[c][j], 0.0001D) end)"
    raw = f"transform({classes}, c -> exp(ln(th.s[c]) + aggregate({rules}, 0D, (a, j) -> a + {vote})))"
    mine = f"transform(pats, e -> transform(array({raw}), r -> transform(r, w -> e.n * w / aggregate(r, 0D, (a, x) -> a + x)))[0])"
    sums = f"transform({classes}, c -> aggregate(m, 0D, (a, r) -> a + r[c]))"
    seen = lambda value: f"aggregate(sequence(0, size(pats) - 1), 0D, (a, i) -> a + if(pats[i].v[j] = {value}, m[i][c], 0D))"
    prior = f"({PRIOR}D * {_sql(s0)}[c] * total)"
    rate = lambda value, base: clip(f"({seen(value)} + {prior} * {_sql(base)}[c][j]) / (u[c] + {prior})")
    new = (
        f"named_struct('s', transform({classes}, c -> {clip(f'(u[c] + {prior}) / ({1 + PRIOR}D * total)')}), 'n', transform({classes}, c -> transform({rules}, j -> {rate(-1, n0)})), "
        f"'p', transform({classes}, c -> transform({rules}, j -> {rate(1, p0)})))"
    )
    step = f"transform(array({mine}), m -> transform(array({sums}), u -> {new})[0])[0]"
    return f"aggregate(sequence(1, {rounds}), named_struct('s', {_sql(s0)}, 'n', {_sql(n0)}, 'p', {_sql(p0)}), (th, k) -> {step})"


def fit(voted: DataFrame, rounds: int = ROUNDS) -> dict:
    """theta after rounds of expectation-maximisation over the counts of vote patterns; start() for an empty table."""
    names = [name for name, _, _ in RULES]
    patterns = voted.groupBy(*(f"v_{j}" for j in names)).agg(F.count("*").cast("double").alias("n"))
    votes_ = F.array(*(F.col(f"v_{j}") for j in names))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("n", votes_.alias("v")))).alias("pats"), F.sum("n").alias("total"))  # 3^rules elements at most
    row = one.where("total > 0").select(F.expr(rounds_sql(rounds)).alias("th")).first()
    theta = start()
    if row is not None:
        for c, share, bad, good in zip(CLASSES, row.th.s, row.th.n, row.th.p, strict=True):
            theta[f"s_{c}"] = share
            theta |= {f"n_{c}_{j}": v for j, v in zip(names, bad, strict=True)} | {f"p_{c}_{j}": v for j, v in zip(names, good, strict=True)}
    return theta


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, FEATURES, base_failed, p_good, kept) of every row of docs.

    kept is false where base_failed (fewer than ten words, or over a fifth of
    the words in repeated 5-word windows), else p_good >= 0.5.  Null and empty
    texts have no words and fail the base.  Repeated rows are judged alike.
    """
    voted = votes(written(features(docs, id_col, text_col), "features"))
    return voted.select(id_col, *FEATURES, F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words").alias("base_failed"), F.expr(posterior_sql(fit(voted))).alias("p_good")).withColumn("kept", F.expr("not base_failed and p_good >= 0.5"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, each by its own text, with an id or without.

    Rows are judged one by one and carry their columns along, so that nothing is
    joined or shuffled; repeated rows and rows that share an id are judged apart.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    return judged(whole, "_row", "_text").where("kept").select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Features and verdict of every document; odd rows as in `judged`."""
    return judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_sql() -> str:
    """DuckDB SQL for op4_quality: features by words as rows, then the same rounds as a chain of one-row tables."""
    cols, names = ", ".join(FEATURES), ", ".join(f"v_{name}" for name, _, _ in RULES)
    count = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    vote = ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end as v_{name}" for name, bad, good in RULES)
    sep = "[ \\x09-\\x0D]+"
    chain, last = [f"th0 as (select {', '.join(f'{v}::double as {k}' for k, v in start().items())})"], "th0"
    for k in range(1, ROUNDS + 1):
        theta = {x: f"th{k - 1}.{x}" for x in start()}
        inner = f"select p.*, {', '.join(f'{weight_sql(theta, c)} as w_{c}' for c in CLASSES)} from patterns p cross join th{k - 1}"
        chain.append(f"th{k} as materialized (select {', '.join(f'{x} as {c}' for c, x in step_sql().items())} from ({inner}))")
        last = f"th{k}"
    theta = {x: f"{last}.{x}" for x in start()}
    return f"""
with d as (select doc_id, coalesce("text", '') as t from documents),
w as (select doc_id, list_filter(regexp_split_to_array(t, '{sep}'), lambda x: x <> '') as w from d),
pos as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w),
five as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as s from pos where i + 4 <= len(w)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as c from five) where c > 1),
cov as (select doc_id, count(distinct i + k) as n from again cross join (select unnest(range(0, 5)) as k) group by doc_id),
ln as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{sep}', '', 'g') <> '') as l from d),
f as (select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '{sep}', '', 'g'))::bigint as word_chars, ({count(SYMBOLS)})::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines, ({count(UPPER)})::bigint as n_upper,
  ({count("!")})::bigint as n_exclaim, len(list_distinct(w))::bigint as n_distinct, ({count(".!?")})::bigint as n_stops,
  ({count(MARKS)})::bigint as n_marks, len(list_filter(w, lambda x: regexp_matches(x, '{BARE}')))::bigint as n_bare, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::bigint as n_again
  from d join w using (doc_id) join ln using (doc_id) left join cov using (doc_id)),
v as materialized (select doc_id, {cols}, {vote} from f),
patterns as materialized (select {names}, count(*)::double as n from v group by all),
{", ".join(chain)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)) and {posterior_sql(theta)} >= 0.5 as kept
from v cross join {last}
"""
