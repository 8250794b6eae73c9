"""A corpus pipeline of five stages; each takes what the one before kept, and all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from murmurlake.llm.common import forget, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the grammar is learned from the labelled rows that training may use."""
    return toxicity.keep_civil(docs, toxicity.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; n_chars (if there is one) follows the text, and documents of which nothing is left go.
    Null texts and texts without repeated lines stay as they are."""
    mark = "_".join(["lines", *docs.columns])  # no column has this name
    done = line_dedup.remove_repeated_lines(docs, into=mark)
    text = F.col(f"`{mark}`.kept_text")
    changed = F.col(f"`{mark}`.n_removed") > 0
    values = {"text": text}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    kept = done.filter(~changed | (F.length(F.trim(text)) > 0))
    return kept.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links one row stays, of least doc_id."""
    return ngram_join.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", civil),
    ("line_dedup", fresh_lines),
    ("ngram_join", one_of_each_group),
    ("decontaminate", uncontaminated),
    ("bpe", encoded),
]

#: SQL can express neither the learned grammar nor the embedding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if spent is not None:
            forget(spent)  # only the last copy of the corpus is left
        spent = docs
    return STAGES[-1][1](spark, docs, sf_dir)
