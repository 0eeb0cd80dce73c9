"""Pieces, spelling variants and hard negatives against the library and against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from payrecon.llm import negatives, pieces, spelling

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  a", "a  b \n\n c ", "▁", "x▁y", "\r\n;\r\n", "日本語 テスト 🎉🎉 ß", "</s><s><unk> <0x0A>", "a" * 3000, "\x00\x01", "é" * 70 + "​﻿",
    " " * 40, "\t\t a\tb", "in" * 33, "the cat " * 900, "word" * 16, "word" * 17,
]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_pieces_are_those_of_the_library(spark, monkeypatch):
    rng, plain = random.Random(4), library()
    texts = ODD + ["".join(rng.choice("  aeinot\n.,▁éß日\r") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    for check in (True, False):
        got = pieces.encode_pieces(docs, pieces.default_model(), check=check).collect()
        want = [(i, [*plain.encode(t or ""), plain.eos_id()]) for i, t, _ in rows]
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=key) == sorted(((i, ids, plain.decode(ids)) for i, ids in want), key=key)
    assert pieces.encode_pieces(docs.limit(0), pieces.default_model()).collect() == []


def test_pieces_in_any_portion_and_by_either_agenda(monkeypatch):
    monkeypatch.setattr(pieces, "AT_ONCE", 50)
    monkeypatch.setattr(pieces, "KEPT", 20)
    monkeypatch.setattr(pieces, "ROW_CELLS", 64)
    with open(pieces.default_model(), "rb") as file:
        model = file.read()
    encoder, texts = pieces.PieceEncoder(model, check=True), [t or "" for t in ODD]
    ids, sizes = encoder.encode(texts * 2)  # compared with the library within
    assert ids.tolist() == [i for t in texts * 2 for i in [*encoder.library.encode(t), 2]] and len(sizes) == 2 * len(texts)
    rng = random.Random(5)
    segments = ["▁" + "".join(rng.choice("aeinotrs▁") for _ in range(rng.randint(0, 63))) for _ in range(400)]
    rows = [np.frombuffer(x, np.int32).tolist() for x in encoder.vocabulary.merged(segments)]
    assert rows == [encoder.vocabulary.one_by_heap(s) for s in segments]
    encoder.vocabulary.end = 1
    with pytest.raises(ValueError):
        encoder.encode(["a"])


class Asked:
    """The library, with the texts that it was asked to encode."""

    def __init__(self, plain):
        self.plain, self.texts, self.decode = plain, [], plain.decode

    def encode(self, texts, **how):
        self.texts += texts
        return self.plain.encode(texts, **how)


def test_the_library_is_asked_for_each_different_segment_once():
    with open(pieces.default_model(), "rb") as file:
        encoder = pieces.PieceEncoder(file.read(), check=True)
    encoder.library = asked = Asked(encoder.library)
    rng, words = random.Random(6), [f"wort{i}" for i in range(300)]
    texts = ["\n".join(" ".join(rng.choices(words, k=40)) for _ in range(10)) for _ in range(60)]
    for some in (texts[:30], texts[30:]):
        ids, sizes, decoded = encoder.both(some)
        assert decoded == some and ids.tolist() == [i for t in some for i in [*asked.plain.encode(t), 2]]
    assert all(sum(bool(re.search(rf"{w}\b", t)) for t in asked.texts) >= 1 for w in words)
    assert sum(map(len, asked.texts)) < sum(map(len, texts)) / 10


def test_wrong_ids_of_a_segment_fail_wherever_it_comes(monkeypatch):
    with open(pieces.default_model(), "rb") as file:
        model = file.read()
    right = pieces.Vocabulary.merged
    for odd in ("wrong", " wrong", "  ", "\n", "\u65e5\u672c"):
        wrong = lambda self, segments, odd=odd: [x[4:] if s == odd else x for s, x in zip(segments, right(self, segments), strict=True)]
        monkeypatch.setattr(pieces.Vocabulary, "merged", wrong)
        for texts in (["a", f"b c\n{odd}\nd"], [f"a b\n{odd}"]):
            encoder = pieces.PieceEncoder(model, check=True)
            for _ in range(2):  # also when a worker tries again
                with pytest.raises(ValueError):
                    encoder.both(texts)


def test_a_text_that_does_not_come_back_is_compared_whole():
    with open(pieces.default_model(), "rb") as file:
        encoder = pieces.PieceEncoder(file.read(), check=True)
    encoder.library = asked = Asked(encoder.library)
    decode, texts = asked.plain.decode, ["one", "two three", "four"]
    asked.decode = lambda ids: decode(ids).replace("three", "3")
    assert encoder.both(texts)[2] == ["one", "two 3", "four"] and asked.texts.count("two three") == 1
    split = encoder.segments
    encoder.segments = lambda text: split(text)[::-1]  # cut in a wrong way
    with pytest.raises(ValueError):
        encoder.both(texts)


def test_vocabularies_of_other_kinds_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    with open(pieces.default_model(), "rb") as file:
        good = file.read()
    for change in (lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.pieces[300], "type", 4), lambda m: m.pieces.pop(7)):
        model = sentencepiece_model_pb2.ModelProto.FromString(good)
        change(model)
        with pytest.raises(ValueError):
            pieces.Vocabulary(model.SerializeToString())


def test_op11_digests(spark):
    from payrecon.llm import registry

    plain = library()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.queries()["op11_sentencepiece"](spark, SF).collect()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == len(docs)
    for r in got:
        ids = [*plain.encode(docs[r.doc_id]), 2]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(plain.decode(ids)))


def plain_variants(rows, least=7, least_count=2, times=10, slips=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= least_count}
    near = {w: set() for w in words}
    holes: dict = {}
    for w in words:
        for i in range(min(len(w), 200)):  # longer words of the fixtures are of one letter
            shorter = w[:i] + w[i + 1 :]
            if shorter in near:
                near[shorter].add(w)
                near[w].add(shorter)
            holes.setdefault((i, shorter), []).append(w)
    for same in holes.values():  # the same but for the letter at i
        for w in same:
            near[w].update(v for v in same if v != w)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling_variants_against_brute_force(spark):
    rng = random.Random(6)
    made = ["".join(rng.choice(("tion", "ing", "er", "Ço", "é", "ß", "a")) for _ in range(rng.randint(3, 6))) for _ in range(120)]
    texts = [" ".join(rng.choice(made[: rng.choice((3, 120))]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["abcdefgh " * 3000, "abcdefg abcdefg " + "abcdefgx " * 30, "Abcdefgx1abcdefgh,ÀÀÀÀÀÀÀ ààààààà × ÷ aaaaaaa×b aaaaaaa×b", "short words only " + "chainaaa " * 200 + "chainaab " * 20 + "chainacb " * 2, None, "", ("z" * 70_000 + " ") * 30 + ("z" * 70_001 + " ") * 2, ("ab" * 24 + " ") * 20 + ("ab" * 24 + "a ") * 2 + ("ba" * 40 + " ") * 3 + ("ba" * 20 + "c" + "ba" * 20 + " ") * 2 + ("ba" * 39 + "cc ") * 2 + ("ba" * 39 + "bc ") * 40]
    rows = [*enumerate(texts), (None, "planted " * 40), (None, "plantedd planted plantedd"), (2, texts[2])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    for slips in (3, 0):
        got = spelling.spelling_variants(docs, slips=slips).collect()
        assert {tuple(r) for r in got} == plain_variants(rows, slips=slips) and len(got) == len({r.word for r in got})
    assert {r.word: r.root for r in got}["chainacb"] == "chainaaa"
    assert spelling.spelling_variants(docs.limit(0)).collect() == [] and spelling.spelling_variants(docs.limit(0)).columns[:3] == ["word", "form", "root"]


def test_grams_that_one_edit_leaves():
    """Whatever the edit and the dictionary, the shorter one of a word and its edit asks for a list that has the other."""
    rng, letters = random.Random(7), "aabé"
    for share in (0.3, 0.02, 0.005, 0.0001):
        words = {"".join(rng.choice(letters) for _ in range(rng.choice((6, 7, 9, 14, 30, 60)))) for _ in range(500)}
        pairs = []
        for w in sorted(words):
            for i in (0, rng.randrange(len(w)), len(w) - 1, len(w)):
                pairs += [(w, w[:i] + rng.choice(letters) + w[i:]), (w, w[:i] + rng.choice("cé") + w[i + 1 :])]
        for most in (2, 3):
            places, frequent = sum(map(len, words)), set()
            for size in range(2, most):
                counts = Counter(w[i : i + size] for w in words for i in range(len(w) - size + 1))
                frequent |= {g for g, n in counts.items() if n > share * places}
            index = spelling.GramIndex(frequent, 6, most)
            for a, b in pairs:
                if a != b:
                    a, b = sorted((a, b), key=lambda w: (len(w), w))
                    asks, kept = index.keys(a), index.keys(b)
                    assert {*asks[0], *asks[2]} & {*kept[0], *kept[1]}, (a, b)
                    assert bin(spelling.signature(a) ^ spelling.signature(b)).count("1") <= 2 and spelling.signature(a) >= 0
    with pytest.raises(ValueError):
        spelling.GramIndex(set(), 5)


def plain_negatives(rows, every, positives, negatives_, ratio):
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for i, lab, v in whole:
        if i % every:
            continue
        scored = sorted(((-dot(v, u), j, k) for j, k, u in whole), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2] == lab and x[1] != i][:positives]:
            fits = [(-t, j) for t, j, k in scored if k != lab and ratio[0] * -s <= ratio[1] * -t <= ratio[1] * -s]
            out.update((i, p, rank, j, -s, t) for rank, (t, j) in enumerate(fits[:negatives_], 1))
    return out


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 23)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 4)
    rng = random.Random(8)
    vectors = [[rng.uniform(-0.5, 0.9) for _ in range(6)] for _ in range(12)]
    rows = [(i, rng.choice((0, 1, 1, 2)), [x + rng.choice((0.0, 0.0, 0.02)) for x in rng.choice(vectors)]) for i in range(260)]
    rows += [(300, 1, None), (310, None, vectors[0]), (320, 1, [0.1, None]), (330, 1, [math.nan]), (340, 1, [math.inf]), (None, 1, vectors[0]), (350, 2, []), (360, 2, vectors[1][:3])]
    rows += [(10, 1, vectors[2]), (10, 1, vectors[2]), (11, 0, vectors[2]), (11, 0, vectors[2]), (-20, -1, vectors[3])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, no int, score string").repartition(4)
    exact = [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    for ratio in ((80, 100), (0, 1)):
        got = Counter(map(tuple, negatives.hard_negatives(negatives.usable(docs), every=10, positives=3, negatives=4, ratio=ratio).collect()))
        assert got == plain_negatives(exact, 10, 3, 4, ratio)
    assert negatives.hard_negatives(negatives.usable(docs.limit(0))).collect() == []
    assert negatives.hard_negatives(negatives.usable(docs), every=7919, positives=3).filter("anchor_id <> 0").collect() == []


def test_packed_products_of_any_width():
    rng = np.random.default_rng(9)
    for most, parts, n in ((1, 1, 1), (2, 3, 50), (160, 64, 101), (5000, 64, 33), (1 << 20, 100, 9), (1 << 28, 8, 5), (0, 4, 3), (3, 0, 4)):
        a, c = rng.integers(-most, most + 1, (7, parts)), rng.integers(-most, most + 1, (n, parts + 2 * (parts > 1)))
        assert np.array_equal(negatives.products(a, c), a @ c[:, :parts].T)
    assert negatives.products(np.zeros((0, 4), np.int64), np.ones((3, 4), np.int64)).shape == (0, 3)
    with pytest.raises(ArithmeticError):
        negatives.products(np.full((1, 2), 1 << 40), np.full((1, 2), 1 << 40))
    with pytest.raises(ArithmeticError):
        negatives.integers(pa.array([[1e300]]))
    scores = np.array([[5, 5, 9, 1 << 61, -3]])
    assert [*negatives.first(scores, np.array([[True, True, False, True, True]]), 3)] == [(0, 3), (0, 0), (0, 1)]


def test_op12_and_op13_queries(spark):
    from payrecon.llm import registry

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = registry.queries()["op12_spelling"](spark, SF).collect()
    assert {tuple(r) for r in got} == plain_variants(docs) and got
    vectors = [(r.vec_id, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = Counter(map(tuple, registry.queries()["op13_hard_negatives"](spark, SF).collect()))
    assert got == plain_negatives(vectors, 100, 5, 5, (80, 100)) and got
