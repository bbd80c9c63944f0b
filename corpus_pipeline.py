"""Documents to tokens: reject toxic ones, keep one of each near-duplicate group, drop contaminated ones, redact secrets, encode.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and works on all rows that the stage before it kept.  All but the last
return the columns of ``documents``.  Rows with a null doc_id are in no
near-duplicate group; null texts pass every stage and have no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.bits import without
from flowlab.llm.bpe import encode, read_ranks
from flowlab.llm.decontaminate import mark_contaminated
from flowlab.llm.near_dup import link_documents
from flowlab.llm.queries import table
from flowlab.llm.secrets import scan_secrets
from flowlab.llm.tables import Tables
from flowlab.llm.text import quoted
from flowlab.llm.toxicity import fit, sample_labelled, score_toxicity

SECRET_MARK = "[SECRET]"
#: What a worker remembers of spans and pre-tokens: the stages share their workers' memory.
MEMO = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(sample_labelled(docs, table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model, MEMO).filter("predicted = 0").select(quoted(docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id stays of those linked by five-word shingles with a similarity of 0.8 or more."""
    linked = link_documents(docs, size=5, percent=80)
    with Tables(spark) as tables:
        return without(docs, tables.keep(tables.store(linked.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct())))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mark_contaminated(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(quoted(docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(docs, mark=SECRET_MARK)
    changed = F.when(F.size("secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return scanned.withColumn("n_chars", changed).select(quoted(docs.columns))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids and n_tokens, and whether the ids decode to the text."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode(docs, ranks, public_tokenizers.PATTERN, check=True, memo_size=MEMO).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", to_tokens),
]

#: SQL can express neither the string kernel nor the guess cost.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    with Tables(spark) as tables:
        for _, stage in STAGES[:-1]:
            docs = tables.store(stage(spark, docs, sf_dir), rows=None)
        return STAGES[-1][1](spark, tables.keep(docs), sf_dir)
