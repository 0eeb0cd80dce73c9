"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, and returns a DataFrame; between two
stages stands a Parquet table. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payrecon.llm.common import scratch, table
from payrecon.llm.decontam import drop_contaminated
from payrecon.llm.language import UNKNOWN, train, with_language
from payrecon.llm.mixing import OWN, mix_sources
from payrecon.llm.simhash import drop_near_copies
from payrecon.llm.tokens import default_tokenizer, token_index, write_tokens
from payrecon.sources.store import made_paths, release, remove, shared_folder

#: Texts in other scripts than those of the learnt languages have a score near 0 (Russian, Greek, Chinese or Arabic
#: prose under 0.1); no held-out document of a learnt language in sf0.1 had less than 0.4, single words included.
LEAST_SCORE = 0.3

#: No SQL: a trained model decides the first stage. Tests compare the others with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, without text, or in none of the languages it has learnt."""
    said = with_language(docs, train(docs), out=("_lang", "_score"))
    kept = said.filter((F.col("_lang") != UNKNOWN) & (F.col("_score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words or more lies in windows of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that every source has the same share, and shuffles them."""
    return mix_sources(docs).drop(*OWN)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids and returns their index: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(spark, "tokens")
    write_tokens(docs, path, default_tokenizer())
    return token_index(spark, path)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written as Parquet and read again; what a stage has stored on its way
    goes once its result is written, and its input too."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        mark = len(made_paths(spark))
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            release(spark, mark)
            if before is not None:
                remove(spark, before)
            docs, before = spark.read.parquet(path), path
    return docs
