"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, language, line_dedup, mixing, negatives, pieces, pii, quality, simhash, spelling, tokens, toxicity, warc

MODULES = (line_dedup, mixing, quality, simhash, decontam, tokens, warc, language, toxicity, pii, pieces, negatives, spelling)


def queries() -> dict:
    import corpus_pipeline

    own = {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit()}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
