"""The registered queries themselves over the smallest tables: columns, one row a document or page, and known digests."""

import hashlib
import zlib

from test_models_and_files import plain_spans
from test_text_ops import groups_of, plain_print

from payrecon.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op3_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_token_ids": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op6_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
    "op10_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


def test_queries_return_what_the_contract_names(spark):
    queries, docs = registry.queries(), {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert len(queries) == 14
    found = {}
    for name, columns in COLUMNS.items():
        out = queries[name](spark, SF)
        assert out.columns[: len(columns)] == columns, name
        found[name] = {r[0]: r for r in out.collect()}
        assert len(found[name]) == (pages if name == "op6_warc" else len(docs)), name
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    prints = {i: plain_print(d.text) for i, d in docs.items()}
    group, least = groups_of(set(prints.values())), {}
    for i in sorted(prints):
        least.setdefault(group[prints[i]], i)
    for i, d in docs.items():
        base, own = plain_spans(d.text or ""), found["op5_personal_data"][i]
        assert own.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest() and own.n_ip == sum(k == "ip" for k, _, _ in base)
        assert set(filter(None, joined(base).split(","))) <= set(own.spans.split(",")) and own.n_spans == len(own.spans.split(",")) * bool(own.spans)
        assert (found["op9_simhash"][i].fingerprint, found["op9_simhash"][i].component_id) == (f"{prints[i]:016x}", least[group[prints[i]]])
        assert found["op7_language_id"][i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert found["op8_toxicity"][i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert found["op8_toxicity"][i].predicted == (found["op8_toxicity"][i].score >= 0.5)
