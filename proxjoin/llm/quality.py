"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Eleven rules look at different faults and vote for good, for bad, or abstain. Rules on one kind of fault (shouting,
repetition) depend on one another and cast one vote together, so nine families vote. A bad document seldom has more
than one fault, so votes aren't independent among bad documents; the model therefore knows one class of good documents
and one kind of bad ones for each family. Expectation-maximisation estimates every class's share and each family's
rate of good votes in it; the posterior of the good class is a document's quality. Rates start with a lean (a kind of
bad documents fails its own family) and are then free; one pseudo-vote of either side keeps them off 0 and 1.

All per-document work is built-in functions; the model is fitted on the counts of vote patterns, of which there are
at most ``3 ** len(FAMILIES)``, whatever the size of the corpus.

Defined results: a null or empty text has no words, fails the base rules and is not kept. Repeated rows are judged
row by row. An empty table gives no rows. Further columns pass through; ``features`` and ``judge`` replace columns named
as those they add, ``keep_good`` touches none.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add, mul

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxjoin.llm.common import SPACES, STOP_WORDS, let, materialize, parcel, unparcel, words_of

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further figures that rules look at.
MORE = ["n_lines", "n_stop_words", "n_upper", "n_exclaimed", "n_numbers", "n_odd_words", "n_unique_words", "n_ended_lines"]
UPPER, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?"
#: Characters that plain words don't hold, and those around a word that don't belong to it.
ODD = SYMBOLS + r"_=+/\{}[]~^@"
EDGES = ".,;:!?\"'()-" + SYMBOLS
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
NUMBER = r"^[0-9][0-9.,:/-]*\z"


def _repeated(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more, by sorting the windows' hashes with their places."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.when(j == F.size(places) - 1, 3).otherwise(F.least(F.lit(3), F.get(places, j + 1) - p)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        found = F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return let(F.array_sort(F.transform(found, lambda x: x["i"])), covered)

    def of(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, twice))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(grams, of))


def _any_of(characters: str) -> str:
    """A pattern for one of the characters."""
    return "[" + "".join("\\" + c if not c.isalnum() else c for c in characters) + "]"


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base figures of each whole text, and the further ones."""
    t = F.coalesce(F.col(text), F.lit(""))
    held = lambda some: F.regexp_count(t, F.lit(_any_of(some))).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    stop = lambda w: F.btrim(F.lower(w), F.lit(EDGES)).isin(sorted(STOP_WORDS))
    odd = lambda w: F.when(t.rlike(_any_of(ODD)), F.size(F.filter(w, lambda x: x.rlike(_any_of(ODD))))).otherwise(F.lit(0))
    out = docs.withColumns({
        "_words": let(words_of(F.col(text)), lambda w: F.struct(
            F.size(w).alias("n"), _repeated(w).alias("r"), F.size(F.filter(w, stop)).alias("s"), odd(w).alias("o"),
            F.when(t.rlike("[0-9]"), F.size(F.filter(w, lambda x: x.rlike(NUMBER)))).otherwise(F.lit(0)).alias("d"),
            F.size(F.array_distinct(w)).alias("u"), F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("c"))),
        "_lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"), F.size(F.filter(x, lambda y: y.rlike(ENDED))).alias("e"))),
        "n_symbols": held(SYMBOLS), "n_upper": held(UPPER), "n_exclaimed": held(MARKS),
    })
    names = {"n_words": "_words.n", "word_chars": "_words.c", "n_repeat_words": "_words.r", "n_stop_words": "_words.s", "n_odd_words": "_words.o", "n_numbers": "_words.d", "n_unique_words": "_words.u", "n_lines": "_lines.n", "n_dup_lines": "_lines.d", "n_ended_lines": "_lines.e"}
    return out.withColumns({k: F.col(v).cast("long") for k, v in names.items()}).drop("_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Each rule as (good, bad), in the names of the figures: SQL that Spark and DuckDB read alike.
RULES = {
    "length": ("n_words >= 100", "n_words < 50"),
    "word_length": ("word_chars >= 4 * n_words AND 2 * word_chars <= 13 * n_words", "2 * word_chars < 5 * n_words OR word_chars > 10 * n_words"),
    # A text without any known stop word may be in another language, a single line a title.
    "stop_words": ("100 * n_stop_words >= 15 * n_words", "n_stop_words > 0 AND 100 * n_stop_words < 8 * n_words"),
    "line_ends": ("100 * n_ended_lines >= 70 * n_lines", "n_lines >= 2 AND 100 * n_ended_lines < 30 * n_lines"),
    "symbols": ("100 * n_symbols <= n_words", "100 * n_symbols > 10 * n_words"),
    "word_shape": ("100 * n_odd_words <= 5 * n_words", "100 * n_odd_words > 25 * n_words"),
    "numbers": ("100 * n_numbers <= 5 * n_words", "100 * n_numbers > 25 * n_words"),
    "upper_case": ("100 * n_upper <= 10 * word_chars", "100 * n_upper > 30 * word_chars"),
    "exclamations": ("100 * n_exclaimed <= 5 * n_words", "100 * n_exclaimed > 25 * n_words"),
    "dup_lines": ("n_dup_lines = 0 AND n_lines > 0", "100 * n_dup_lines > 30 * n_lines"),
    "repeats": ("100 * n_repeat_words <= 10 * n_words", "100 * n_repeat_words > 40 * n_words"),
    "unique_words": ("100 * n_unique_words >= 40 * n_words", "100 * n_unique_words < 20 * n_words"),
}
#: Rules that cast one vote together: bad if one says so, good if none does and as many as the number say good.
FAMILIES = {
    "length": (["length"], 1), "word_length": (["word_length"], 1), "stop_words": (["stop_words"], 1), "line_ends": (["line_ends"], 1),
    "symbols": (["symbols"], 1), "word_shape": (["word_shape"], 1), "numbers": (["numbers"], 1),
    "shouting": (["upper_case", "exclamations"], 1), "repetition": (["dup_lines", "repeats", "unique_words"], 2),
}
ROUNDS = 60
#: Where rates of good votes start: of good documents, of bad ones, and of a kind of bad ones in its own family.
GOOD, BAD, OWN, PRIOR = 0.98, 0.8, 0.1, 0.8


def _family_sql(name: str) -> str:
    members, least = FAMILIES[name]
    praised = " + ".join(f"CASE WHEN {RULES[m][0]} THEN 1 ELSE 0 END" for m in members)
    return f"CASE WHEN {' OR '.join(f'({RULES[m][1]})' for m in members)} THEN -1 WHEN {praised} >= {least} THEN 1 ELSE 0 END"


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 for good, -1 for bad, 0 where it abstains."""
    return {name: F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for name, (good, bad) in RULES.items()}


def votes() -> dict[str, Column]:
    """Each family's vote."""
    return {name: F.expr(_family_sql(name)) for name in FAMILIES}


def starts(width: int) -> np.ndarray:
    """Rates from which the fit starts: the good class, then one kind of bad documents for each family."""
    bad = np.full((width, width), BAD)
    np.fill_diagonal(bad, OWN)
    return np.vstack([np.full(width, GOOD), bad])


def estimate(patterns: Iterable[tuple[Sequence[int], int]], rates: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes, and each class's rates of good votes among those cast, from the counts of vote patterns.

    The first class is the good one.
    """
    data = sorted((tuple(v), c) for v, c in patterns if c)
    share = np.r_[PRIOR, np.full(len(rates) - 1, (1 - PRIOR) / (len(rates) - 1))]
    if not data:
        return share, rates
    v, count = np.array([x for x, _ in data]), np.array([c for _, c in data], float)
    good, cast = (v > 0).astype(float), (v != 0).astype(float)
    for _ in range(rounds):
        each = share * np.where(v[:, None] > 0, rates, np.where(v[:, None] < 0, 1 - rates, 1.0)).prod(axis=2)
        weight = (count / each.sum(axis=1))[:, None] * each
        share = 1 + weight.sum(axis=0)
        share /= share.sum()
        rates = (1 + weight.T @ good) / (2 + weight.T @ cast)
    return share, rates


def fit(patterns: Iterable[tuple[Sequence[int], int]], rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """Prior log-odds of good and each voter's log-odds of being right, with bad documents of one kind only."""
    data = [(v, c) for v, c in patterns if c]
    width = len(data[0][0]) if data else len(FAMILIES)
    share, rates = estimate(data, np.array([[BAD] * width, [1 - BAD] * width]), rounds)
    right = share[0] * rates[0] + share[1] * (1 - rates[1])
    logit = lambda p: math.log(p / (1 - p))
    return logit(float(share[0])), [logit(float(x)) for x in right]


def posterior(share: np.ndarray, rates: np.ndarray) -> Column:
    """The probability of the good class from the columns of votes, each of which is computed once."""

    def of(vote: Column) -> Column:
        def chance(k: int) -> Column:
            each = [F.when(vote[n] > 0, F.lit(float(r))).when(vote[n] < 0, F.lit(float(1 - r))).otherwise(F.lit(1.0)) for n, r in zip(FAMILIES, rates[k], strict=True)]
            return F.lit(float(share[k])) * reduce(mul, each)

        return chance(0) / reduce(add, [chance(k) for k in range(len(share))])

    return let(F.struct(*[F.col(f"_vote_{n}").alias(n) for n in FAMILIES]), of)


def judge(featured: DataFrame) -> DataFrame:
    """Add ``quality`` (posterior probability), ``base_failed`` and ``kept``. Reads ``featured`` twice: pass a stored table."""
    voted = featured.withColumns({f"_vote_{n}": v for n, v in votes().items()})
    names = [f"_vote_{n}" for n in FAMILIES]
    counted = voted.groupBy(*names).count().collect()  # 3 ** 9 rows at most
    share, rates = estimate([(tuple(row[:-1]), row[-1]) for row in counted], starts(len(FAMILIES)))
    out = voted.withColumn("quality", posterior(share, rates)).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop(*names)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept."""
    judged = judge(materialize(features(parcel(docs, text), "_text")))
    return unparcel(judged.where("kept"), docs, text)


def oracle_sql() -> str:
    """The whole of it in DuckDB SQL: the model is a recursive table with a row for each round and class."""
    space = r"[\x20\x09-\x0D]"
    width = len(FAMILIES)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    held = lambda some: f"(length(t) - length(translate(t, {quoted(some)}, '')))::BIGINT"
    stop = "[" + ", ".join(quoted(w) for w in sorted(STOP_WORDS)) + "]"
    v, r = [f"v{j}" for j in range(width)], [f"r{j}" for j in range(width)]
    chance = " * ".join(["w", *(f"CASE WHEN {a} > 0 THEN {b} WHEN {a} < 0 THEN 1 - {b} ELSE 1 END" for a, b in zip(v, r, strict=True))])
    begin = ", ".join(f"({k}, {PRIOR if k == 0 else (1 - PRIOR) / width!r}::DOUBLE, " + ", ".join(f"{x!r}::DOUBLE" for x in row) + ")" for k, row in enumerate(starts(width).tolist()))
    rates = ", ".join(f"(1 + coalesce(sum(c * e / t) FILTER ({a} > 0), 0)) / (2 + coalesce(sum(c * e / t) FILTER ({a} <> 0), 0)) AS {b}" for a, b in zip(v, r, strict=True))
    families = ", ".join(f"{_family_sql(name)} AS {a}" for name, a in zip(FAMILIES, v, strict=True))
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM n, range(3) s(k) WHERE n > 1 GROUP BY r),
f AS (SELECT d.r AS doc_row, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {held(SYMBOLS)} AS n_symbols,
  len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: list_contains({stop}, trim(lower(x), {quoted(EDGES)})))) AS n_stop_words, {held(UPPER)} AS n_upper, {held(MARKS)} AS n_exclaimed, len(list_filter(ws, lambda x: regexp_matches(x, '{NUMBER}'))) AS n_numbers,
  len(list_filter(ws, lambda x: translate(x, {quoted(ODD)}, '') <> x)) AS n_odd_words, len(list_distinct(ws)) AS n_unique_words, len(list_filter(ls, lambda x: regexp_matches(x, '{ENDED}'))) AS n_ended_lines
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
v AS (SELECT *, {families} FROM f),
pattern AS (SELECT {", ".join(v)}, count(*)::DOUBLE AS c, row_number() OVER () AS p FROM v GROUP BY {", ".join(v)}),
model(round, k, w, {", ".join(r)}) AS (SELECT 0, * FROM (VALUES {begin})
  UNION ALL SELECT round + 1, k, n / sum(n) OVER (), {", ".join(r)} FROM (SELECT round, k, 1 + sum(c * e / t) AS n, {rates}
  FROM (SELECT *, sum(e) OVER (PARTITION BY p) AS t FROM (SELECT model.round, model.k, pattern.*, {chance} AS e FROM model CROSS JOIN pattern WHERE model.round < {ROUNDS})) GROUP BY round, k)),
judged AS (SELECT p, sum(e) FILTER (k = 0) / sum(e) AS q FROM (SELECT p, k, {chance} AS e FROM model CROSS JOIN pattern WHERE round = {ROUNDS}) GROUP BY p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND q >= 0.5 AS kept, round(q, 6) AS quality
FROM v JOIN pattern USING ({", ".join(v)}) JOIN judged USING (p)"""
