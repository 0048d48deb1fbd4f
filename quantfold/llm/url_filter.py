"""URL filters by a temporal list join.

A list is a log of dated entries: ``list_name``, ``verdict`` (block or allow),
``key`` (a host, a parent domain, or a host with a path prefix such as
``a.example.org/private``), ``action`` (add or remove) and ``effective`` (date). Each
(list, key) becomes validity intervals: an add opens one, the next entry closes it.
A capture is tested against the intervals that hold on its fetch date: its keys are
its host, the parent domains of two labels or more, and the host with each leading
part of the path. The longest matching key decides; at equal length allow wins;
without a match the URL is allowed.

Each different (url, fetch date) is evaluated once. The join has equal keys and a
date range; captures are salted and the intervals repeated per salt, so a host with
a third of all captures is spread over ``SALTS`` tasks per key.

Defined cases: a null URL or one without a host matches no entry; a null fetch date
matches none; entries with a null key, date or action are left out; at one date a
removal comes before an addition; repeated entries open no second interval; repeated
captures are kept; empty tables are fine (no lists: everything allowed); other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def keys_of(url: Column) -> Column:
    """Keys under which a URL can be listed."""
    labels = F.split(host_of(url), "\\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    steps = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda s: s != "")
    paths = F.transform(
        F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")),
    )
    return F.when(host_of(url) != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, verdict, key, valid_from, valid_to (exclusive, null: open)."""
    log = entries.filter(F.col("key").isNotNull() & F.col("effective").isNotNull() & F.col("action").isin("add", "remove")).select("list_name", "verdict", "key", "action", "effective").distinct()
    order = Window.partitionBy("list_name", "verdict", "key").orderBy("effective", F.col("action").desc())
    return (
        log.withColumn("valid_to", F.lead("effective").over(order))
        .filter((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("effective"))))
        .select("list_name", "verdict", "key", F.col("effective").alias("valid_from"), "valid_to")
    )


def filter_urls(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """page_id, url, fetched, host, n_active (entries that hold), matched_key, lists (of that key, sorted), allowed."""
    rows = captures.select("page_id", "url", "fetched")
    different = rows.select("url", "fetched").distinct().filter(F.col("url").isNotNull() & F.col("fetched").isNotNull())
    keyed = different.select("url", "fetched", F.pmod(F.xxhash64("url", "fetched"), F.lit(salts)).cast("int").alias("salt"), F.explode(keys_of(F.col("url"))).alias("key"))
    spans = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    holds = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    active = keyed.join(spans, ["key", "salt"]).filter(holds)
    best = F.max(F.struct(F.length("key").alias("n"), "key", (F.col("verdict") == "allow").alias("allow")))
    listed = F.array_sort(F.collect_set(F.struct("key", "list_name")))
    decided = active.groupBy("url", "fetched").agg(F.count("*").alias("n_active"), best.alias("best"), listed.alias("lists"))
    decided = decided.select(
        F.col("url").alias("u"), F.col("fetched").alias("f"), "n_active", F.col("best.key").alias("matched_key"), F.col("best.allow").alias("allow"),
        F.concat_ws(",", F.transform(F.filter("lists", lambda x: x["key"] == F.col("best.key")), lambda x: x["list_name"])).alias("lists"),
    )
    return rows.join(decided, (F.col("url") == F.col("u")) & (F.col("fetched") == F.col("f")), "left").select(
        "page_id", "url", "fetched", host_of(F.col("url")).alias("host"), F.coalesce("n_active", F.lit(0)).alias("n_active"),
        "matched_key", F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("allow", F.lit(True)).alias("allowed"),
    )
