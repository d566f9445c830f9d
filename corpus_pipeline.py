"""From raw documents to encoded training text: five filters in a row, each a stage of its own.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept, as a table. All but the last
return the columns of ``documents``; rows are never changed, only dropped. The last stage gives each kept
document's token ids and the text decoded from them, with digests of both.

A stage's own tables in the shared folder are removed when the next stage starts, whose input is the stage's written
output; those of the last stage go with the next run.

Rows with a NULL id or text, repeated rows and columns beyond those of ``documents`` pass as the operators
define: a NULL text has no words and is rejected by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quantframe.llm import bpe, decontamination, near_dedup, quality_rules, toxicity
from quantframe.session import Scope, materialize, scratch_scope

VOCABULARY = "word_bpe_49k.json"
TOXIC_FROM = 0.5
_open: dict[SparkSession, Scope] = {}


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that owns the tables it makes, and removes those of the stage before."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if before := _open.pop(spark, None):
            before.drop()
        own = _open[spark] = Scope(spark)
        with scratch_scope(spark, own):
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source."""
    return quality_rules.apply_quality_rules(docs).filter("_verdict.kept").select("row.*")


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half. The model learns from all labels of the stage's input."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(f"score < {TOXIC_FROM}").select("row.*")


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: shingles of five words, similarity 0.8."""
    return near_dedup.drop_near_duplicates(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminate(docs, benchmark).filter("size(items) = 0").select("row.*")


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, the text decoded from them, n_tokens and digests of both."""
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path(VOCABULARY))
    done = bpe.digests(docs, vocabulary, keep=["doc_id", "lang", "source"])
    return done.select("row.*", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", apply_quality_rules),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The toxicity model, signatures and merges have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again, and removed once the next are."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        kept, own = step(spark, docs, sf_dir), Scope(spark)
        with scratch_scope(spark, own):
            docs = materialize(kept, name)
        if held:
            held.drop()
        held = own
    return STAGES[-1][1](spark, docs, sf_dir)
