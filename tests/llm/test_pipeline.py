"""The corpus pipeline's stages, each on its own input, against plain readings of their rules; planted cases; clean-up."""

import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
from test_text_ops import groups_of, plain_contamination, plain_print

import corpus_pipeline
from payrecon.llm import tokens
from payrecon.sources import store

SF = "/root/testdata/sf0.001"


def plain_copies(rows, seed=17):
    """The Poisson number of each row at its own uniform number, all sources at one share."""
    count = Counter(r.source for r in rows)
    out = []
    for r in rows:
        rate = len(rows) / (len(count) * count[r.source])
        u = (int(hashlib.md5(f"{seed}|1|{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        n, p = 0, math.exp(-rate)
        total = p
        while total < u and n < 1000:
            n += 1
            p *= rate / n
            total += p
        out += [r.doc_id] * n
    return Counter(out)


def test_stages_against_plain_rules(spark):
    from tokenizers import Tokenizer

    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    texts = {r.doc_id: r for r in docs.collect()}
    some = next(r for r in texts.values() if r.text and len(r.text.split()) > 300)
    item = next(b.text for b in bench if len((b.text or "").split()) >= 30)
    odd = [(10**6, some.text, "en", "odd", 1), (10**6 + 1, some.text + " tail", "en", "odd", 1), (10**6 + 2, item, "en", "odd", 1), (10**6 + 3, "Это обычный русский текст о погоде.", None, "odd", 1)]
    odd += [(10**6 + 4, None, None, None, None), (10**6 + 5, "12 34", None, None, None), (10**6 + 6, "", "en", None, None)]
    here = docs.unionByName(spark.createDataFrame(odd, docs.schema))

    said = corpus_pipeline.language_id(spark, here, SF)
    assert said.columns == docs.columns
    rows = said.collect()
    letters = {r.doc_id for r in here.collect() if r.text and any(map(str.isalpha, r.text))}
    assert {r.doc_id for r in rows} == letters - {10**6 + 3}

    kept = corpus_pipeline.near_dedup(spark, said, SF).collect()
    prints = {r.doc_id: plain_print(r.text) for r in rows}
    group = groups_of(set(prints.values()))
    least = {}
    for i in sorted(prints):
        least.setdefault(group[prints[i]], i)
    assert sorted(r.doc_id for r in kept) == sorted(least.values()) and 10**6 + 1 not in {r.doc_id for r in kept}

    kept_df = spark.createDataFrame(kept, docs.schema)
    clean = corpus_pipeline.decontaminate(spark, kept_df, SF).collect()
    bad = set()
    for r in kept:
        n, hit, _ = plain_contamination(r.text, [(b.item_id, b.text) for b in bench])
        if hit and 20 * hit >= n:
            bad.add(r.doc_id)
    assert 10**6 + 2 in bad and {r.doc_id for r in clean} == {r.doc_id for r in kept} - bad

    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(clean, docs.schema), SF)
    assert mixed.columns == docs.columns
    mixed = mixed.collect()
    assert Counter(r.doc_id for r in mixed) == plain_copies(clean)

    plain = Tokenizer.from_file(tokens.default_tokenizer())
    want, start = [], 0
    for r in sorted(mixed, key=lambda r: r.doc_id):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.token_ids(spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


def test_stages_on_nothing_and_clean_up(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
    mark = len(store.made_paths(spark))
    made = corpus_pipeline.run(spark, SF)
    left = [p for p in store.made_paths(spark)[mark:] if os.path.isdir(p.removeprefix("file:"))]
    assert made.count() > 0 and all("/tokens-" in p for p in left)  # what the result is read from
    store.release(spark, mark)
    assert not any(os.path.isdir(p.removeprefix("file:")) for p in left)
