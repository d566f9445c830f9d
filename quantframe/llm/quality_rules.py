"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every document gets five shares (symbols, repeated windows, repeated lines, capitals, characters per word).
A quantile sketch of each share is kept per language and source: counts of buckets that keep the upper six binary
digits of a share, so sketches merge by adding counts, their size depends on the value range only, and the result
does not depend on the order or the partitions of the rows. A share may exceed its group's median by ``spread`` times
the distance from the median to the upper quartile, on the share's own scale; a group with hardly any spread uses
``LEAST_SPREAD`` for that distance. There are no fixed cutoffs: every limit moves with its group's median. Sketches of
a source with few documents give way to the merged sketch of the language, and that to the merged sketch of all.
Documents are joined with the thresholds of their group.

Defined cases: NULL text has no words and fails; NULL language or source counts as the empty name; repeated
rows are judged one by one; a very long text is judged whole; a share equal to its limit is kept; an empty table
gives no rows; other columns are carried along untouched, in the struct ``row``, where no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.llm.common import SPACES, let, words_of
from quantframe.session import materialize

SYMBOLS = "#*$%&|<>"
#: Characters counted as capitals: ASCII, and the Latin-1 capitals.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least distance, in thousandths, that is taken for the one between a group's median and upper quartile.
LEAST_SPREAD = {"symbols": 10, "repeats": 40, "lines": 60, "capitals": 12, "width": 250}
STATS = "_stats"


@dataclass(frozen=True)
class Rules:
    """``spread``: how many times the distance from the median to the upper quartile a share may exceed the median;
    ``min_group``: documents that a sketch needs to be used."""

    spread: int = 6
    min_group: int = 200
    min_words: int = 50
    max_repeat_percent: int = 50


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more. Windows are compared by a 64-bit hash.

    Sorted hashes show repeats as neighbours; only a text with repeats sorts its windows with positions. A
    window at distance d from the next repeated one adds min(d, 3) words.
    """
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                         lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(placed, lambda p: F.sort_array(F.transform(F.filter(
            p, lambda e, j: (F.get(p, j - 1)["h"] == e["h"]) | (F.get(p, j + 1)["h"] == e["h"])), lambda e: e["i"])))
        return let(repeated, lambda at: F.aggregate(
            F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3)))),
            F.lit(0), lambda total, n: total + n))

    def count(windows: Column) -> Column:
        twice = let(F.sort_array(windows), lambda s: F.size(F.filter(s, lambda h, j: h == F.get(s, j - 1))))
        return F.when(twice == 0, F.lit(0)).otherwise(covered(windows))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashes, count))


def text_stats(text: Column) -> Column:
    """A struct of the base counts of one text and what the shares need."""
    whole = F.coalesce(text, F.lit(""))
    squeezed = F.translate(whole, SPACES, "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, SPACES, "") != "")

    def drop(characters: str) -> Column:
        return (F.length(whole) - F.length(F.translate(whole, characters, ""))).cast("long")

    return F.struct(
        let(words_of(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(squeezed).cast("long").alias("word_chars"),
        drop(SYMBOLS).alias("n_symbols"),
        drop(CAPITALS).alias("n_capitals"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"))


def _per_mille(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(F.lit(0)).cast("long")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with a struct ``_stats`` of the counts."""
    df = docs.withColumn(STATS, text_stats(F.col(text)))
    s = F.col(STATS)
    return df.withColumn(STATS, F.struct(
        s["w"]["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"),
        s["l"]["n_dup_lines"].alias("n_dup_lines"), s["w"]["n_repeat_words"].alias("n_repeat_words"),
        s["n_capitals"].alias("n_capitals"), s["l"]["n_lines"].alias("n_lines")))


def _shares(s: Column) -> dict[str, Column]:
    return {"symbols": _per_mille(s["n_symbols"], s["n_words"]), "repeats": _per_mille(s["n_repeat_words"], s["n_words"]),
            "lines": _per_mille(s["n_dup_lines"], s["n_lines"]), "capitals": _per_mille(s["n_capitals"], s["word_chars"]),
            "width": _per_mille(s["word_chars"], s["n_words"])}


def _bucket(share: Column) -> Column:
    """The share with all but its upper six binary digits cleared: the lowest value of its bucket."""
    rest = F.pow(F.lit(2), F.greatest(F.length(F.bin(share)) - 6, F.lit(0))).cast("long")
    return share - share % rest


def sketches(stats: DataFrame, lang: Column, source: Column, rules: Rules) -> DataFrame:
    """(lang, source, share, bucket, n) over documents with words."""
    shares = F.array(*(F.struct(F.lit(k).alias("share"), _bucket(v).alias("bucket"))
                       for k, v in _shares(F.col(STATS)).items()))
    return (stats.filter(F.col(f"{STATS}.n_words") > 0)
            .select(F.coalesce(lang.cast("string"), F.lit("")).alias("lang"),
                    F.coalesce(source.cast("string"), F.lit("")).alias("source"), F.inline(shares))
            .groupBy("lang", "source", "share", "bucket").agg(F.count(F.lit(1)).alias("n")))


def _quantile(q: float) -> Column:
    """Lowest bucket that at least a share q of the documents does not exceed."""
    return F.min(F.when(F.col("upto") * 1000 >= F.col("total") * round(q * 1000), F.col("bucket")))


def _limits(sketch: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """One row per group of ``keys``: the highest value allowed per share, and the documents seen."""
    merged = sketch.groupBy(*keys, "share", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "share")
    placed = merged.withColumns({"upto": F.sum("n").over(by.orderBy("bucket")), "total": F.sum("n").over(by)})
    edges = placed.groupBy(*keys, "share").agg(_quantile(0.5).alias("mid"), _quantile(0.75).alias("high"),
                                               F.max("total").alias("docs"))
    least = F.create_map(*(x for k, v in LEAST_SPREAD.items() for x in (F.lit(k), F.lit(v))))
    spread = F.greatest(F.col("high") - F.col("mid"), least[F.col("share")].cast("long"))
    limited = edges.withColumn("limit", F.col("mid") + spread * rules.spread)
    return limited.groupBy(*keys).agg(
        F.max("docs").alias("docs"), *(F.max(F.when(F.col("share") == k, F.col("limit"))).alias(k) for k in LEAST_SPREAD))


def thresholds(sketch: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(lang, source, one limit per share) for every group: its own sketch, its language's, or that of all.

    The driver gets one row, the limits of all documents.
    """
    own = _limits(sketch, ["lang", "source"], rules)
    broad = _limits(sketch, ["lang"], rules).select("lang", F.struct("*").alias("by_lang"))
    every = _limits(sketch.withColumn("_all", F.lit(0)), ["_all"], rules).first()
    joined = own.join(broad, "lang")

    def pick(name: str) -> Column:
        return (F.when(F.col("docs") >= rules.min_group, F.col(name))
                .when(F.col("by_lang.docs") >= rules.min_group, F.col(f"by_lang.{name}"))
                .otherwise(F.lit(every[name] if every else None).cast("long")).alias(name))

    return joined.select("lang", "source", *(pick(k) for k in LEAST_SPREAD))


def judge(stats: DataFrame, limits: DataFrame, lang: Column, source: Column, rules: Rules = Rules()) -> DataFrame:
    """``stats`` with structs ``_stats`` and ``_verdict`` (base_failed, rejected_by, kept).

    The thresholds have one row per group; the documents of a dominant group are split by adaptive execution.
    """
    left = stats.withColumns({"_lang": F.coalesce(lang.cast("string"), F.lit("")),
                              "_source": F.coalesce(source.cast("string"), F.lit(""))})
    table = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                          F.struct(*LEAST_SPREAD).alias("_limits"))
    joined = left.join(table, ["_lang", "_source"], "left")
    s = F.col(STATS)
    failed = (s["n_words"] < rules.min_words) | (
        s["n_repeat_words"] * 100 > s["n_words"] * rules.max_repeat_percent)
    over = F.array_compact(F.array(*(
        F.when(v > F.col("_limits")[k], F.lit(k)) for k, v in _shares(s).items())))
    verdict = F.struct(failed.alias("base_failed"), over.alias("rejected_by"),
                       (~failed & (F.size(over) == 0)).alias("kept"))
    return joined.withColumn("_verdict", verdict).drop("_lang", "_source", "_limits")


def _judged(stats: DataFrame, lang: Column, source: Column, rules: Rules) -> DataFrame:
    """Counts are taken once and kept as a table, then summed to sketches and joined with their limits."""
    stats = materialize(stats, "stats")
    sketch = materialize(sketches(stats, lang, source, rules), "sketches")
    return judge(stats, thresholds(sketch, rules), lang, source, rules)


def apply_quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                        rules: Rules = Rules()) -> DataFrame:
    """One row per input row: struct ``row`` of the input, structs ``_stats`` and ``_verdict``."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    stats = with_stats(packed.withColumn("_t", F.col("row")[text]), "_t").drop("_t")
    return _judged(stats, F.col("row")[lang], F.col("row")[source], rules)


def quality_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the shares over their limits."""
    stats = with_stats(docs.select("doc_id", "text", "lang", "source")).drop("text")
    judged = _judged(stats, F.col("lang"), F.col("source"), rules)
    return judged.select("doc_id", *(f"{STATS}.{c}" for c in BASE), "_verdict.base_failed", "_verdict.kept",
                         F.array_join("_verdict.rejected_by", ",").alias("rejected_by"))
