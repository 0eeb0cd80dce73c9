"""Operator 12, spelling variants of words by an index of variable-length grams."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shipped, bounded_batches, stored, table

#: Runs of letters; a fixed pattern.
RUN = "[A-Za-zÀ-ÿ]+"
#: Letters of grams; a gram that has over SHARE of all places of words is extended by a letter.
LEAST, MOST, SHARE = 2, 3, 0.0002
#: Blocks of places of an edit, at most; up to as many letters each place is one.
BLOCKS = 8
#: Longer words have no part in the counts of grams, and are compared in another way.
LONG = 48
#: Different words that a task counts before it hands their counts on.
COUNTED = 200_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7, slips: int = 0) -> DataFrame:
    """`word, n` of the runs of letters of all texts, A-Z lower-cased, that have `least_letters` code points or more.

    With `slips`, misspellings are planted: where crc32 h of `<id>:<run>` is divisible by it, the run loses its code
    point h % length (a null id counts as an empty one). Null and empty texts have no words; a text is read whole.
    """
    bounded_batches(docs.sparkSession)
    find = re.compile(RUN).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, n in Counter(find((text or b"").lower().decode("utf-8", "replace"))).items():
                    if slips and (h := zlib.crc32(run.encode(), before)) % slips == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= least_letters:
                        words[run] += n
                if len(words) >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array([*words]), pa.array([*words.values()], pa.int64())], ["word", "n"])
                    words.clear()
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([*words]), pa.array([*words.values()], pa.int64())], ["word", "n"])

    texts = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame, share: float = SHARE, most: int = MOST) -> set[str]:
    """Grams of LEAST to most - 1 letters with over `share` of all places: those that are extended.

    The dictionary of the index follows from them: all grams of LEAST letters, and those of which the gram without its
    last letter is here. They are pruned level by level, as a gram cannot be more frequent than its beginning. A
    letter of a word is one place, so each level has 1 / share grams at most, whatever the words are.
    """
    spark, words = words.sparkSession, words.filter(F.char_length("word") <= LONG)
    places = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    found: set[str] = set()
    above: list[str] | None = None
    for size in range(LEAST, most):
        at = F.sequence(F.lit(1), F.char_length("word") - (size - 1))
        grams = words.filter(F.char_length("word") >= size).select(F.explode(F.transform(at, lambda p, size=size: F.substring("word", p, F.lit(size)))).alias("gram"))
        if above is not None:
            known = F.broadcast(spark.createDataFrame([(g,) for g in above], "g string"))  # 1 / share rows at most
            grams = grams.join(known, F.substring("gram", 1, size - 1) == F.col("g"), "left_semi")
        counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share * places)
        above = [r.gram for r in counted.collect()]
        found |= {*above}
        if not above:
            break
    return found


def signature(word: str) -> int:
    """A bit for each letter and how often it came before, 31 bits in all: of words that one edit parts it differs in two
    bits at most."""
    seen: dict[str, int] = {}
    out = 0
    for c in word:
        k = seen[c] = seen.get(c, -1) + 1
        out |= 1 << (ord(c) + 13 * k) % 31
    return out


class GramIndex:
    """Words as variable-length grams, and the grams that an edit cannot affect.

    The gram at a place is the longest of the dictionary there, less those that lie within an earlier one. An edit (a
    letter replaced or taken out at i, or one put in before i) affects the grams that hold i; those to its left that may
    grow over it, since the letters from there to i begin a longer gram; and those to its right that an earlier gram may
    swallow, since the letters up to there end a longer one. How far that reaches on either side follows from letters
    that the edit leaves alone, so that a word and its edit tell the same bounds. All grams before and behind are grams
    of both, at the same place counted from the beginning or from the end.
    """

    def __init__(self, frequent: set[str], least_letters: int, most: int = MOST) -> None:
        if least_letters < 2 * most:
            raise ValueError("an edit may affect all grams of words that short")
        self.frequent, self.least_letters, self.most = frequent, least_letters, most

    def grams(self, word: str) -> list[tuple[int, int]]:
        """(first, last place) of the grams of a word, in order."""
        out, reach, n, q, frequent = [], -1, len(word), self.most, self.frequent
        for p in range(n - LEAST + 1):
            size = LEAST
            while size < q and p + size < n and word[p : p + size] in frequent:
                size += 1
            if p + size - 1 > reach:
                reach = p + size - 1
                out.append((p, reach))
        return out

    def lists(self, word: str, grams: list[tuple[int, int]], letters: int) -> list[tuple[int, str, str]]:
        """For each block of edits of a word of so many `letters`, of which `word` is an edit with one more, or the word
        itself: (its first place, what the grams before those affected spell, what the grams behind them spell)."""
        n, q, frequent = len(word), self.most, self.frequent
        more, count, k, j = n - letters, min(letters, BLOCKS), 0, 0
        out = []
        for block in range(count):
            low, high = block * letters // count, (block + 1) * letters // count - 1 + more
            left, right = low, high
            while left > 0 and low - left + 1 < q and (low - left + 1 < LEAST or word[left - 1 : low] in frequent):
                left -= 1
            while right + 1 < n and right - high + 2 <= q and (right - high < LEAST or word[high + 1 : right + 1] in frequent):
                right += 1
            while k < len(grams) and grams[k][0] < left:
                k += 1
            while j < len(grams) and (grams[j][0] <= high or grams[j][1] <= right):
                j += 1
            out.append((low, word[: grams[k - 1][1] + 1] if k else "", word[grams[j][0] :] if j < len(grams) else ""))
        return out

    def keys(self, word: str) -> tuple[list[int], list[int], list[int]]:
        """Keys as signed 64-bit hashes: of the word and others of its length, under which it is found and asks; those under
        which shorter words find it; those under which it asks for longer words. For each block of edits a list is of the
        words that have all the grams that these cannot affect.
        """
        n, grams = len(word), self.grams(word)
        named = lambda more, letters, lists: [xxhash.xxh64_intdigest(f"{more} {letters} {low} {before} {behind}") - (1 << 63) for low, before, behind in lists]
        own = self.lists(word, grams, n)
        same = named(0, n, own)
        longer = named(1, n - 1, self.lists(word, grams, n - 1)) if n > self.least_letters else []
        return same, longer, named(1, n, own)


def _one_edit(u: Column, v: Column) -> Column:
    """Of different words, v as long as u or a letter longer: one edit parts them. The letters they begin with alike are
    found by halving, as Spark's distance looks at long words again from the beginning for every letter."""
    steps = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
    more = lambda p, step: (p + step <= F.char_length(u)) & (F.substring(u, 1, p + step) == F.substring(v, 1, p + step))
    alike = F.aggregate(steps, F.lit(0), lambda p, step: F.when(more(p, step), p + step).otherwise(p))
    rest = lambda word, n: F.substring(word, alike + n, F.char_length(word))
    return F.when(F.char_length(u) == F.char_length(v), rest(u, 2) == rest(v, 2)).otherwise(rest(u, 1) == rest(v, 2))


def near_words(words: DataFrame, least_letters: int = 7, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`word, n, near, near_n`: both directions of every pair of different words (`word, n`, each once) that differ by one
    inserted, deleted or replaced code point. Words have `least_letters` code points or more."""
    index = Shipped(words.sparkSession, GramIndex(frequent_grams(words, share, most), least_letters, most))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = [index.get().keys(w) for w in words]
            lists = [pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in range(3)]
            marks = pa.array([signature(w) for w in words], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks, *lists], ["word", "n", "mark", "same", "kept", "asked"])

    keyed = stored(words.select("word", "n").mapInArrow(keys, "word string, n long, mark int, same array<long>, kept array<long>, asked array<long>"), "spelling-keys")
    side = lambda more, as_: keyed.select(F.explode(F.concat("same", more)).alias("key"), *[F.col(c).alias(a) for c, a in zip(("word", "n", "mark"), (as_, f"{as_}_n", f"{as_}_mark"), strict=True)])
    kept, asks = side("kept", "v"), side("asked", "u")
    likely = F.bit_count(F.col("u_mark").bitwiseXOR(F.col("v_mark"))) <= 2  # spares most pairs the distance
    shorter = F.char_length("u") - F.char_length("v")
    once = (shorter < 0) | ((shorter == 0) & (F.col("u") < F.col("v")))
    met = lambda u, v: asks.filter(u).join(kept.filter(v).hint("merge"), "key").filter(likely & once)
    short = met(F.char_length("u") <= LONG, F.char_length("v") <= LONG).filter(F.levenshtein("u", "v", 1) == 1)
    long = met(F.char_length("u") >= LONG, F.char_length("v") > LONG).filter(_one_edit(F.col("u"), F.col("v")))
    pairs = stored(short.union(long).select("u", "u_n", "v", "v_n").distinct(), "spelling-pairs")
    names = ["word", "n", "near", "near_n"]
    return pairs.toDF(*names).union(pairs.select("v", "v_n", "u", "u_n").toDF(*names))


def with_roots(words: DataFrame) -> DataFrame:
    """`word, form` with `root`: from word along forms to the last, by pointers that jump twice as far each round."""
    at = stored(words.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("_via"), F.col("root").alias("_next"))
        moved = at.join(on, F.col("root") == F.col("_via"), "left")
        at = stored(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        if at.filter("_moved").isEmpty():
            break
        at = at.select("word", "root")
    roots = at.select(F.col("word").alias("_of"), "root")
    return words.join(roots, F.col("word") == F.col("_of"), "left").withColumn("root", F.coalesce("root", "word")).drop("_of")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7, least_count: int = 2, times: int = 10, slips: int = 0
) -> DataFrame:
    """`word, form, root, n, n_near, form_n` of every word of `least_letters` or more that comes `least_count` times or more.

    Words are those of word_counts(); two are near if they differ by one inserted, deleted or replaced code point. A
    word's form is its near word of largest n (of equals the first by code points) if that is `times` its own n or
    more, else null; its root is what forms lead to in the end.

    Defined cases: null and empty texts have no words; a null id counts as an empty one where slips are planted, and
    is of no account else; repeated rows count each; an empty table gives an empty table; other columns are not read.

    At scale: texts become counts in the tasks that read them, and only counts are shuffled. Each word stands in some 15
    lists and asks for some 15, each merged from the lists of all grams that a block of edits leaves, so that the words of
    a list differ in a few letters in one place; the distance is part of the join, so that only near words leave it. Long
    lists are joined by sorting, which Spark splits. The dictionary has at most 1 / share grams a length, whatever the
    number of words.
    """
    words = stored(word_counts(docs, id_col, text_col, least_letters, slips).filter(F.col("n") >= least_count), "spelling-words")
    near = near_words(words, least_letters)
    best = near.groupBy(F.col("word").alias("_word")).agg(F.count(F.lit(1)).alias("_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("_best"))
    judged = words.join(best, F.col("word") == F.col("_word"), "left")
    strong = -F.col("_best.least") >= times * F.col("n")
    formed = judged.select(
        "word", "n", F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("_best.near")).alias("form"), F.when(strong, -F.col("_best.least")).alias("form_n")
    )
    return with_roots(stored(formed, "spelling-forms")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), slips=31)
