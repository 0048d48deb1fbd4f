"""Registered queries of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantfold.llm import (
    chat_format,
    decontaminate,
    license_scan,
    near_join,
    quality_model,
    quality_rules,
    secret_scan,
    source_divergence,
    source_mixing,
    substring_dedup,
    token_counts,
    turn_repair,
    url_filter,
)
from quantfold.llm.common import table


def url_lists(pages: DataFrame) -> DataFrame:
    """List entries that follow from the hosts of ``pages``: dated by digests of their keys.

    Three lists: hosts (added, some removed and added again), parent domains that
    are blocked from a date on, and path prefixes that are allowed again.
    """
    host = url_filter.host_of(F.col("url"))
    hosts = pages.select(host.alias("host"), F.regexp_extract("url", "^[^:]+://[^/?#]+/([^/?#]+)", 1).alias("step")).filter("host <> ''")
    number = lambda c, salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), c)), 1, 6), 16, 10).cast("long")
    day = lambda c, salt: F.date_add(F.lit("2024-01-01").cast("date"), (number(c, salt) % 366).cast("int"))
    entry = lambda name, verdict, key, action, when: (F.lit(name).alias("list_name"), F.lit(verdict).alias("verdict"), key.alias("key"), F.lit(action).alias("action"), when.alias("effective"))
    h = F.col("host")
    single = hosts.select("host").distinct()
    bad = single.filter(number(h, "bad:") % 3 == 0)
    first = day(h, "a:")
    domain = F.substring_index(h, ".", -2)
    domains = single.select(domain.alias("key")).distinct()
    path = F.concat(h, F.lit("/"), F.col("step"))
    paths = hosts.filter("step <> ''").select(path.alias("key")).distinct().filter(number(F.col("key"), "path:") % 4 == 0)
    return (
        bad.select(*entry("hosts", "block", h, "add", first))
        .unionByName(bad.filter(number(h, "r:") % 2 == 0).select(*entry("hosts", "block", h, "remove", F.date_add(first, 40))))
        .unionByName(bad.filter(number(h, "r:") % 4 == 0).select(*entry("hosts", "block", h, "add", F.date_add(first, 100))))
        .unionByName(domains.select(*entry("domains", "block", F.col("key"), "add", F.date_add(F.lit("2024-07-01").cast("date"), (number(F.col("key"), "d:") % 180).cast("int")))))
        .unionByName(paths.select(*entry("paths", "allow", F.col("key"), "add", day(F.col("key"), "p:"))))
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; the tables have no fetch dates, so each page has one that follows from its id (days of 2024)."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    return url_filter.filter_urls(pages.select("page_id", "url", fetched.alias("fetched")), url_lists(pages))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.sql("SELECT -7L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, r'\\### Assistant: </turn> ok' AS text FROM range(2)")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    parts = chats.select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    out = chat_format.format_chats(parts)
    loss = out.withColumns({"turns_text": chat_format.read_turns(F.col("formatted")), "loss_text": chat_format.read_loss(F.col("segments"))})
    return loss.select(
        "conv_id", chat_format.count_turns(F.col("formatted")).alias("n_turns"), F.sha2("turns_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_join.near_groups(table(spark, sf_dir, "documents"), near_join.Rule(width=3, num=90, den=100))
    return groups.select("doc_id", "n_shingles", "component_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.zipf_vocabulary())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "space_pm", "symbol_pm", "dup_line_pm", "space_pm_least", "space_pm_limit", "symbol_pm_limit", "dup_line_pm_limit", "sketch_level",
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"), number("novel"),
    )


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows by a checksum of their key: 1 in 20 is dropped, emptied, loses its sentence ends, is repeated or becomes a user row, each."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    changed = conversations.withColumn("kind", kind).filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), "kind"
    )
    return changed.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repaired conversation is one string here, made for its digest only."""
    chats = table(spark, sf_dir, "conversations")
    convs, turns = turn_repair.repair_conversations(damaged(chats), chats)
    line = F.struct("place", F.concat_ws(":", "role", "text").alias("line"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("whole"))
    both = convs.alias("c").join(whole.alias("w"), F.col("c.conv_id").eqNullSafe(F.col("w.conv_id")), "left")
    return both.select("c.*", F.sha2(F.coalesce("whole", F.lit("")), 256).alias("repaired_sha256"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_url_filters, op2_chat_formatting, op3_ngram_jaccard_join, op4_benchmark_decontamination, op5_quality_classifier,
        op6_source_mixing, op7_token_counts, op8_quality_rules, op9_secret_scans, op10_license_scans,
        op11_source_divergence, op12_substring_dedup, op13_conversation_repair,
    ]
    return {f.__name__: f for f in found}
