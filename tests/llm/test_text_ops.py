"""Line dedup, mixing, quality, SimHash and decontamination against plain readings of their rules."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from payrecon.llm import decontam, line_dedup, mixing, quality, simhash
from payrecon.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _th string, _h1 int"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
TEXTS = [
    "a b c\nd e f\ng h i\nj k", "x\na b c\nd e f\ng h i\ny", "", None, "   \n\n\n  ", "one", "one two", "A b  C d", "a B c d",
    "same line\nsame line\nsame line\nsame line\nsame line", LONG, LONG + " tail", "é ü ß\nä ö", "a b c\nd e f\ng h i\nj k",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", None, "clash", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "a b c\nd e f\ng h i\nj k", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def as_rows(df):
    return [r.asDict() for r in df.collect()]


def kept_lines(rows, window=3):
    """Plain reading: (id, text) pairs in order, null ids first, equal pairs once."""
    texts = sorted({(r["doc_id"], r["text"]) for r in rows if r["text"] is not None}, key=lambda x: (x[0] is not None, x[0] or 0, xxhash.xxh64_intdigest(x[1].encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(x[1].encode(), 42) >> 63)))
    seen, out = {}, {}
    for key in texts:
        lines = key[1].split("\n")
        for i in range(len(lines) - window + 1):
            win = tuple(lines[i : i + window])
            if any(x.strip(" \t\n\v\f\r") for x in win):
                seen.setdefault(win, (key, i))
    for key in texts:
        lines = key[1].split("\n")
        gone = set()
        for i in range(len(lines) - window + 1):
            win = tuple(lines[i : i + window])
            if win in seen and seen[win] != (key, i):
                gone |= set(range(i, i + window))
        out[key] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_line_dedup(docs):
    rows = as_rows(docs)
    want = kept_lines(rows)
    got = as_rows(line_dedup.dedup_lines(docs))
    assert len(got) == len(rows)
    expected = Counter((r["doc_id"], *(want[(r["doc_id"], r["text"])] if r["text"] is not None else (None, 0))) for r in rows)
    assert Counter((r["doc_id"], r["text"], r["n_removed"]) for r in got) == expected
    assert sum(r["n_removed"] for r in got) > 8


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    assert line_dedup.dedup_lines(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert quality.quality_filter(none).count() == 0
    assert simhash.near_copies(none).count() == 0
    assert simhash.drop_near_copies(none).count() == 0
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_mixing_rates_and_repeats(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else "cold", i) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copy long")
    once = mixing.mix_sources(docs, {"hot": 1.0, "cold": 3.0})
    got = Counter(r["source"] for r in once.select("source").collect())
    assert abs(got["hot"] - 1500) < 5 * 1500**0.5 and abs(got["cold"] - 4500) < 5 * 4500**0.5
    key = lambda df: sorted((r.doc_id, r.mix_copy, r.mix_order) for r in df.collect())
    assert key(once) == key(mixing.mix_sources(docs.repartition(17), {"hot": 1.0, "cold": 3.0}))
    assert set(once.columns) == {"doc_id", "text", "source", "mix_copy", "mix_order"}
    big = mixing.mix_sources(docs.limit(20), {"hot": 1.0, "cold": 0.0})
    assert {r.source for r in big.collect()} == {"hot"}


def test_mixing_keeps_columns_and_splits_many_copies(spark, docs):
    rows = [(i, f"t{i}", None if i == 5 else "hot" if i % 7 else "one", "s", 2.0, 3, "w", "c", 1) for i in range(3000)] + [(None, "x", "hot", "s", 2.0, 3, "w", "c", 1)] * 2
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, _src string, _rate double, _steps int, _who string, _cdf string, _mix int")
    out = mixing.mix_sources(odd)
    assert out.columns == [*odd.columns, "mix_copy", "mix_order"]
    got = as_rows(out)  # the null source has one row, and so a rate of a thousand
    assert {(r["_src"], r["_rate"], r["_steps"], r["_who"], r["_cdf"], r["_mix"]) for r in got} == {("s", 2.0, 3, "w", "c", 1)}
    copies = Counter((r["doc_id"], r["source"]) for r in got)
    assert abs(copies[(5, None)] - 3002 / 3) < 5 * (3002 / 3) ** 0.5 and copies[(None, "hot")] % 2 == 0
    assert all(sorted(r["mix_copy"] for r in got if r["doc_id"] == i) == list(range(1, copies[(i, s)] + 1)) for i, s in copies if i in (5, 7, 14))


def test_mixing_large_rate(spark):
    docs = spark.createDataFrame([(i, "t", "a" if i == 0 else "b") for i in range(1500)], "doc_id long, text string, source string")
    n = mixing.mix_sources(docs, {"a": 1.0, "b": 0.0}).count()
    assert abs(n - 1500) < 5 * 1500**0.5


def plain_measures(text):
    words = [w for w in re.split(r"[ \t\n\v\f\r]+", text or "") if w]
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t\n\v\f\r]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def plain_kept(text):
    n, chars, symbols, dup, repeats = plain_measures(text)
    words = [w for w in re.split(r"[ \t\n\v\f\r]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t\n\v\f\r]", x)]
    letters = sum(c.isalpha() for c in text or "")
    if n < 20 or 100 * repeats > 30 * n or 10 * symbols > n or (len(lines) >= 4 and 10 * dup > 3 * len(lines)):
        return False
    most = Counter(words).most_common(1)[0][1]
    return not (chars < 2 * n or chars > 15 * n or letters == 0 or 10 * letters < 3 * chars or 2 * most > n)


ODD = [
    (90, "a b c d e f g h i j " * 9), (91, "# $ % word " * 10 + "\nx\nx\nx"), (92, "p q r s t u v w\n" * 2), (93, " ".join(f"{i * 7919}" for i in range(40))),
    (94, " ".join(f"{i * 7919} ab" for i in range(40))), (95, " ".join(f"the word{i}" if i % 2 else "the the" for i in range(30))), (96, "x" * 2000 + " " + "yz " * 25),
    (97, " ".join(f"plain{i} words{i % 7}" for i in range(30))), (98, "\n".join([*["same"] * 9, *[f"line {i} of text" for i in range(9)]])),
]


def test_quality(spark, docs):
    rows = docs.select("doc_id", "text", F.lit("own").alias("_words"), F.lit(1).alias("kept")).union(spark.createDataFrame([(*x, "own", 1) for x in ODD], "doc_id long, text string, a string, b int"))
    names = ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")
    got = as_rows(quality.quality_filter(rows, show=names, sample_rows=20))
    want = Counter((r["doc_id"], *plain_measures(r["text"]), plain_kept(r["text"])) for r in as_rows(rows))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["lines"]["dup"], r["n_repeat_words"], r["kept"]) for r in got) == want
    assert {r["_words"] for r in got} == {"own"} and {r["kept"] for r in got} == {True, False}
    for order in (list(quality.RULES), list(reversed(quality.RULES))):
        lazy = as_rows(quality.quality_filter(rows, order=order))
        assert Counter((r["doc_id"], r["kept"]) for r in lazy) == Counter((x[0], x[-1]) for x in want.elements())
    many = docs.select("doc_id", "text").union(spark.createDataFrame([(i, f"word{i} " * (i % 60)) for i in range(300)], "doc_id long, text string"))
    assert [r.name for r in quality.rule_order(many.repartition(3), sample_rows=200, there=("n_words",))][0] == "too_short"


def test_quality_computes_dear_measures_behind_cheap_ones(spark):
    """A text that a cheap rule rejects never meets the dear one, which here would fail the job."""
    bomb = quality.Rule("bomb", ("n_words",), lambda m: F.raise_error(F.concat(F.lit("computed for "), m("n_words").cast("string"))).cast("boolean"))
    few = spark.createDataFrame([(i, "two words") for i in range(9)], "doc_id long, text string")
    out = quality.quality_filter(few, order=[quality.RULES[0], bomb])
    assert {(r.rejected_by, r.kept) for r in out.collect()} == {("too_short", False)}
    with pytest.raises(Exception, match="computed for"):
        quality.quality_filter(few, order=[bomb, quality.RULES[0]]).collect()


def plain_print(text):
    words = [w for w in re.split(r"[ \t\n\v\f\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = sorted(root)
    for i, a in enumerate(ps):
        for b in ps[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in ps}


def test_simhash(spark, docs):
    base = " ".join(f"q{i * 7919 % 1000}" for i in range(400))
    near = [(100 + i, base.replace(f"q{i * 7919 % 1000}", "zz", 1)) for i in range(40)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    plain = as_rows(rows)
    prints = {r["text"]: plain_print(r["text"]) for r in plain}
    group = groups_of(set(prints.values()))
    least = {}
    for r in plain:
        g = group[prints[r["text"]]]
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{prints[r['text']]:016x}", least.get(group[prints[r["text"]]])) for r in plain)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in as_rows(simhash.near_copies(rows))) == want
    kept = as_rows(simhash.drop_near_copies(rows))
    assert Counter(group[prints[r["text"]]] for r in kept) == Counter(set(group.values()))


def test_links_by_balls(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for p in base for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.u, r.v) for r in simhash.near_links(spark.createDataFrame([(p,) for p in signed], "_fp long")).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3}
    assert got == want


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 300).selectExpr("id - 1 AS u", "id AS v").filter("v != 150")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 if i < 150 else 150 for i in range(300)}


def plain_contamination(doc, items, window=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = cut(doc), set(), set()
    for item, text in items:
        w = cut(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(item)
    return len(words), len(hit), tuple(sorted(x for x in found if x is not None))


def test_decontamination(spark):
    import random

    rng = random.Random(5)
    vocab = ["ab", "Cé", "d1", "e", "the", "of"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(f"i{i}", say(rng.choice((1, 5, 12, 13, 14, 40)) if i else 0)) for i in range(14)] + [("i3", say(20)), ("n", None), (None, say(30)), ("d", "x! Y? z.")]
    items.append(("copy", items[-2][1]))
    docs = [(i, say(rng.randint(0, 30)) + " ... " + (items[i % len(items)][1] or "")[rng.randint(0, 9) :] + " " + say(rng.randint(0, 60))) for i in range(60)]
    docs += [(70, None), (71, ""), (None, "X y Z"), docs[1]]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    found = Counter((r._id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect())
    assert found == Counter((i, *plain_contamination(t, items)) for i, t in docs)


def test_winnowing_keeps_one_of_every_window():
    words = decontam.Words(" ".join(f"w{i * i % 50}" for i in range(500)).encode())
    grams = words.grams(5)
    kept = set(decontam.winnowed(grams, 9).tolist())
    assert all(kept & set(range(i, i + 9)) for i in range(len(grams) - 8))
    assert zlib.crc32(words.text(0, 3).encode()) == zlib.crc32(b"w0 w1 w4")
