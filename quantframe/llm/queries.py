"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.llm import (
    bpe, collocations, decontamination, fill_in_middle, html_extraction, language_model, near_dedup, quality_classifier,
    quality_rules, repeated_windows, token_files, toxicity, url_filter)
from quantframe.llm.common import fold_of
from quantframe.session import materialize, scratch_path

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a classifier that learned from three folds of the labels."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = fold_of("doc_id", 4) == 2
    weights = quality_classifier.fit(docs, labels, training=~held)
    scored = quality_classifier.score(docs, weights, keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def captures_and_lists(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures with fetch times, and dated list entries, both derived from the pages.

    The pages have no fetch time and no lists come with them, so both follow from ids, hosts and hashes: a third
    of the hosts is put on a list, half of these taken off later and some put back; an allowing list holds a few
    hosts, and some sections of hosts are listed by prefix.
    """
    captures = pages.select("page_id", "url", F.expr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(pmod(page_id * 7919, 366) as int))").alias("fetched_at"))
    hosts = pages.select(F.regexp_replace(url_filter.host_of(F.col("url")), r"^m\.", "").alias("host"),
                         url_filter.path_of(F.col("url")).alias("path")).filter("host is not null")
    sections = hosts.select("host", F.regexp_extract("path", "^/([^/]+)/", 1).alias("section")).distinct()

    def nibbles(column: str, start: int) -> F.Column:
        return F.conv(F.substring(F.md5(column), start, 4), 16, 10).cast("int")

    named = hosts.select("host").distinct().withColumns({
        "a": nibbles("host", 1), "b": nibbles("host", 5), "c": nibbles("host", 9)})

    def entry(name: str, kind: str, pattern: F.Column, action: str, day: F.Column) -> list[F.Column]:
        stamp = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(day.cast("int"))
        return [F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"),
                F.lit(action).alias("action"), stamp.alias("ts")]

    host, start = F.col("host"), F.col("b") % 300
    listed = named.filter("a % 3 = 0")
    parts = sections.filter("section <> ''").withColumn("key", F.concat_ws("/", "host", "section")).withColumn(
        "a", nibbles("key", 1))
    entries = (listed.select(*entry("adult", "host", host, "add", start))
               .union(listed.filter("c % 2 = 0").select(*entry("adult", "host", host, "remove", start + 40)))
               .union(listed.filter("c % 4 = 0").select(*entry("adult", "host", host, "add", start + 60)))
               .union(named.filter("c % 11 = 0").select(*entry("trusted", "host", host, "add", F.col("b") % 100)))
               .union(parts.filter("a % 5 = 0").select(*entry("malware", "prefix", F.col("key"), "add", F.col("a") % 366))))
    return captures, entries


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries that held when it was fetched."""
    captures, entries = captures_and_lists(_table(spark, sf_dir, "pages"))
    found = url_filter.filter_urls(captures, entries, "page_id", allowing=("trusted",))
    return found.select("page_id", F.array_join("lists", ",").alias("lists"), "blocked")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encoded and decoded text of all documents."""
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path(VOCABULARY))
    done = bpe.digests(_table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
    return done.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    done = html_extraction.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return done.select("row.page_id", "row.url", "text", "n_chars", "n_blocks")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", (F.size("items") > 0).alias("contaminated"), "items", "overlap_words")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that learned from four folds of the labels."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = fold_of("doc_id", 5) == 0
    model = toxicity.fit(docs, labels, training=~held)
    scored = toxicity.score(docs, model, keep=["doc_id"]).select("row.doc_id", "score", "n_segments")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "n_segments")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that learned from four folds of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold_of("doc_id", 5) == 1
    model, counts = language_model.fit(docs, ~held)
    scored = language_model.score(docs, model, counts, keep=["doc_id"]).select(
        "row.doc_id", "n_tokens", "n_known", "base_score", "score")
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
                         "base_score", "score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: shingles of three words, similarity 0.85."""
    settings = near_dedup.Settings(width=3, percent=85)
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), settings=settings)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents."""
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return token_files.token_file_digest(spark, path)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as compressed frames, cut and rearranged, with digests of the outputs and of what they restore."""
    stored = materialize(fill_in_middle.seekable(_table(spark, sf_dir, "documents"), keep=["doc_id"]), "frames")
    done = fill_in_middle.output_digests(fill_in_middle.fill_in_middle(stored))
    return done.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language over all documents."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 400-byte strings that occur more than once."""
    done = repeated_windows.remove_repeated(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_classifier, op2_url_filter, op3_bpe, op4_html_extraction, op5_decontamination, op6_toxicity,
        op7_language_model, op8_near_dedup, op9_quality_rules, op10_token_files,
        op11_fill_in_middle, op12_collocations, op13_repeated_windows)}
