"""URL filters by dated lists: an as-of join of captures with list entries.

A list is kept as dated entries (list, kind, pattern, action, time): ``add`` puts the pattern on the list,
``remove`` takes it off. Entries become validity intervals, half open, from one change to the next; a capture is
judged by the intervals that hold at its fetch time. Kinds: ``host`` (the host or any host below it), ``prefix``
(the start of host and path, cut at slashes). A list blocks or allows; an allowing list wins.

Each distinct capture has a bounded number of keys, one per host suffix and path prefix. Keys are joined with the
intervals of their pattern; those of one list and pattern do not overlap, so each gives a capture one row at most, and
no pattern is gathered. A key of very many captures is split by adaptive execution. Only keys, URLs and times are
joined: verdicts meet the captures once, by URL and time.

Defined cases: a NULL or unreadable URL and a NULL time match nothing and pass; every capture has its own row, also
where keys are NULL or repeat with other URLs or times; changes of one pattern at one time are applied removal first;
unknown actions and kinds are ignored; empty lists let everything pass, an empty table gives no rows; a very long URL
has a key per label and path part; a key column named as a result keeps its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?(/[^?#]*)?"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a closing dot; NULL where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, SCHEME, 1)), r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path without query and fragment, at least a slash."""
    path = F.regexp_extract(url, SCHEME, 2)
    return F.when(path == "", F.lit("/")).otherwise(path)


def keys_of(url: Column) -> Column:
    """Array of (kind, key): each suffix of the host, and host plus each prefix of the path."""
    labels = F.split(host_of(url), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(
        F.lit("prefix").alias("kind"),
        F.concat_ws("/", host_of(url), F.when(i > 0, F.array_join(F.slice(parts, 1, i), "/"))).alias("key")))
    return F.when(host_of(url).isNotNull(), F.array_union(hosts, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) from (list, kind, pattern, action, ts)."""
    known = entries.filter(F.col("action").isin("add", "remove") & F.col("ts").isNotNull() & F.col("pattern").isNotNull())
    # the last change at one time decides: removals come first, so an add at the same time holds
    changes = known.groupBy("list", "kind", "pattern", "ts").agg(F.max(F.col("action") == "add").alias("on"))
    by = Window.partitionBy("list", "kind", "pattern").orderBy("ts")
    before = changes.withColumn("was", F.lag("on").over(by)).filter(~F.col("on").eqNullSafe(F.col("was")))
    ends = before.withColumn("valid_to", F.lead("ts").over(by)).filter("on")
    return ends.select("list", "kind", "pattern", F.col("ts").alias("valid_from"), "valid_to")


def match(captures: DataFrame, entries: DataFrame, url: str = "url", ts: str = "fetched_at") -> DataFrame:
    """(_url, _ts, _lists) for the distinct captures that some list holds at their fetch time; ``_lists`` is sorted."""
    spans = intervals(entries).select(F.col("kind").alias("_kind"), F.col("pattern").alias("_key"), F.col("list").alias("_list"),
                                      F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"))
    asked = captures.select(F.col(f"`{url}`").alias("_url"), F.col(f"`{ts}`").alias("_ts")).distinct()
    keyed = asked.select("_url", "_ts", F.inline(keys_of(F.col("_url")))).withColumnsRenamed({"kind": "_kind", "key": "_key"})
    held = (F.col("_from") <= F.col("_ts")) & (F.col("_to").isNull() | (F.col("_ts") < F.col("_to")))
    return keyed.join(spans, ["_kind", "_key"]).filter(held).groupBy("_url", "_ts").agg(
        F.array_sort(F.collect_set("_list")).alias("_lists"))


def filter_urls(captures: DataFrame, entries: DataFrame, key: str, allowing: tuple[str, ...] = (), url: str = "url",
                ts: str = "fetched_at") -> DataFrame:
    """(key, lists, blocked) for each capture, whatever its key. A result whose name is that of the key gets a ``_``."""
    rows = captures.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{url}`").alias("_url"), F.col(f"`{ts}`").alias("_ts"))
    lists = F.coalesce("_lists", F.array().cast("array<string>"))
    allowed = F.arrays_overlap(lists, F.lit(list(allowing))) if allowing else F.lit(False)
    lists_name, blocked_name = (n + "_" * (n == key) for n in ("lists", "blocked"))
    return rows.join(match(captures, entries, url, ts), ["_url", "_ts"], "left").select(
        F.col("_id").alias(key), lists.alias(lists_name), ((F.size(lists) > 0) & ~allowed).alias(blocked_name))
