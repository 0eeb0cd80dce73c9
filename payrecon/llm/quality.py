"""Operator 3, quality rules as a short-circuit cascade (DataFrame functions only)."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, stored, table, unused

#: Rows of the sample, about, on which the order of the rules is estimated. It changes the speed, never a verdict.
SAMPLE_ROWS = 1500
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows of `window` words that are found twice or more in the text, the first one included.

    Window hashes are sorted with their positions, equal neighbours are repeats, and one pass merges their
    intervals: n log n in the words of a text. Texts without a repeat stop after the hashing.
    """

    def hashes(one: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(one) - window),
            lambda i: F.xxhash64(*[F.get(one, i + j) for j in range(window)]),
        )

    def positions(ordered: Column) -> Column:
        again = F.filter(
            ordered,
            lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]),
        )
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at,
            start,
            lambda a, p: F.struct((a["n"] + window - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + window).alias("end")),
        )["n"]

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, lambda o: covered(positions(o))))

    one = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(one, lambda x: let(hashes(x), count)))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _most_said(words: Column) -> Column:
    """How often the middle one of the sorted words comes: if a word is more than half of all, it is that one."""
    middle = F.get(F.sort_array(words), F.floor(F.size(words) / 2).cast("int"))
    return let(middle, lambda m: F.size(F.filter(words, lambda w: w == m)))


#: What rules look at, as expressions over a text (never null) and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words),
    "word_chars": lambda text, words: F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
    "n_symbols": lambda text, words: F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")),
    "lines": lambda text, words: let(_lines(text), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
    "n_repeat_words": lambda text, words: repeated_words(words),
    "has_letter": lambda text, words: text.rlike(r"\p{L}"),
    "n_letters": lambda text, words: F.length(F.regexp_replace(text, r"\P{L}+", "")),
    "most_said": lambda text, words: _most_said(words),
}

Measure = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where `fails` holds; it gets a function that gives a measure by name."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[Measure], Column]


#: The first two are the base; the rest are loose bounds that prose does not come near.
RULES = (
    Rule("too_short", ("n_words",), lambda m: m("n_words") < 20),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("duplicate_lines", ("lines",), lambda m: let(m("lines"), lambda x: (x["n"] >= 4) & (10 * x["dup"] > 3 * x["n"]))),
    Rule("word_length", ("n_words", "word_chars"), lambda m: let(m("word_chars"), lambda c: (c < 2 * m("n_words")) | (c > 15 * m("n_words")))),
    Rule("no_letters", ("has_letter",), lambda m: ~m("has_letter")),
    Rule("few_letters", ("word_chars", "n_letters"), lambda m: 10 * m("n_letters") < 3 * m("word_chars")),
    Rule("one_word", ("n_words", "most_said"), lambda m: (m("n_words") >= 20) & (2 * m("most_said") > m("n_words"))),
)


def _inline(text: str, words: str, there: dict[str, str]) -> Measure:
    """Gives a measure's column where there is one, else its expression, which is computed where it stands."""
    return lambda name: F.col(there[name]) if name in there else MEASURES[name](F.col(text), F.col(words))


def rule_order(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", there: tuple[str, ...] = ()) -> list[Rule]:
    """The rules by rejections per second, best first, as measured on some `sample_rows` documents.

    The sample is the rows of the smallest hashes of id and text, stored. A rule's cost is the lesser time of two
    passes that compute its measures alone, less that of a pass that only cuts the words; its selectivity is the
    share of the sample that it rejects. Rules of which all measures are `there` cost nothing and come first. Costs
    are rounded to powers of four, so that the same table gives the same order; ties keep the order given.
    """
    n = docs.count()
    share = F.pmod(F.xxhash64(F.lit(3), id_col, text_col), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample_rows / max(1, n))))
    few = stored(docs.filter(share).select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "quality-sample").withColumn("_words", words_of(F.col("_text")))
    get = _inline("_text", "_words", {})

    def seconds(*columns: Column) -> float:
        """Of the lesser of two passes."""
        took = []
        for _ in range(2):
            began = time.monotonic()
            few.agg(F.sum(F.size("_words")).alias("w"), *[F.max(F.xxhash64(c)).alias(f"c{i}") for i, c in enumerate(columns)]).collect()
            took.append(time.monotonic() - began)
        return min(took)

    counts = few.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.coalesce(r.fails(get), F.lit(False))).alias(r.name) for r in rules]).first()
    idle, score = seconds(), []
    for rule in rules:
        cost = 0.0 if set(rule.needs) <= set(there) else 4.0 ** round(math.log(max(1e-3, seconds(*[get(x) for x in rule.needs]) - idle), 4))
        score.append(math.inf if cost == 0 else counts[rule.name] / max(1, counts["all"]) / cost)
    return [rule for _, rule in sorted(zip(score, rules, strict=True), key=lambda x: -x[0])]


def cascade(order: list[Rule], get: Measure) -> Column:
    """The name of the first rule that rejects, null if none does. Conditions are tried in order; what stands behind
    the first that holds is not computed."""
    chain = None
    for rule in order:
        hit = F.coalesce(rule.fails(get), F.lit(False))
        chain = F.when(hit, rule.name) if chain is None else chain.when(hit, rule.name)
    return F.lit(None).cast("string") if chain is None else chain


def quality_filter(
    docs: DataFrame, rules=RULES, show: tuple[str, ...] = (), order: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """docs' columns with the measures that `show` names, `rejected_by` (the first rule that fails) and `kept`.

    Measures that are not shown stand inside the branches of the cascade: a document that a rule has rejected pays
    for no later one. Measures that are shown are computed for every document, and rules that need only these come
    first. The order is estimated on a sample and only moves time about (and which of several failing rules is
    named): a document is kept if and only if no rule fails, in any order.

    Defined cases: null and empty texts have no words and fail `too_short`; repeated rows, null ids and ties are
    judged row by row; an empty table gives an empty table; input columns named as the outputs are replaced.

    At scale: one narrow pass, no shuffle; sorting within a text is n log n, so that long texts stay linear but for
    the logarithm.
    """
    order = rule_order(docs, rules, sample_rows, id_col, text_col, show) if order is None else order
    text, words = unused("_text", docs), unused("_words", docs)
    own = docs.select(*[c for c in docs.columns if c not in (*show, "rejected_by", "kept")], F.coalesce(F.col(text_col), F.lit("")).alias(text))
    cut = own.withColumn(words, words_of(F.col(text)))
    kept = [c for c in own.columns if c != text]
    seen = cut.select(*kept, text, words, *[MEASURES[x](F.col(text), F.col(words)).alias(x) for x in show])
    judged = seen.withColumn("rejected_by", cascade(order, _inline(text, words, {x: x for x in show})))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop(text, words)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")
    judged = quality_filter(table(spark, sf_dir, "documents").select("doc_id", "text"), show=counts)
    base = RULES[0].fails(F.col) | RULES[1].fails(F.col)
    whole = [F.col(c).cast("long").alias(c) for c in counts if c != "lines"]
    return judged.select("doc_id", *whole[:3], F.col("lines.dup").cast("long").alias("n_dup_lines"), whole[3], base.alias("base_failed"), "kept")


SQL = {
    "op3_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i : i + 7], ' ')) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM h WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, regexp_matches(text, '\p{L}') AS has_letter,
    length(regexp_replace(text, '\P{L}+', '', 'g')) AS n_letters, coalesce(list_max(map_values(list_histogram(words))), 0) AS most
  FROM w LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
    OR (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR NOT has_letter
    OR 10 * n_letters < 3 * word_chars OR (n_words >= 20 AND 2 * most > n_words)) AS kept
FROM m""",
}
