"""Quality rules with thresholds that adapt to each language and source.

Every document gets fixed base measures. The method's measures (shares of white space
and of symbol characters, share of repeated lines, per mille) are summarised in one quantile sketch per
(language, source): counts per value bin, values below 64 exact and larger ones
kept to their six leading bits, so a quantile is off by 1/32 of itself at most.
Sketches merge by adding counts. A group of fewer than ``min_docs`` documents
takes the merged sketch of its language, and a language of too few documents the
sketch of all. With the quartiles of a sketch the limits of a measure are

    75 % quantile + SPREAD * (75 % - 25 % quantile) + slack
    25 % quantile - SPREAD * (75 % - 25 % quantile) - slack

(one-sided measures: a quarter of the 75 % quantile is added, and 0 is the lower limit)
and a group's limits go beyond those of its language, and a language's beyond those of all, by
their width at most, so that a source of mostly junk does not set its own limits.

Defined cases: null and blank texts have no words and fail the base rule; null
``lang`` or ``source`` is a group of its own; repeated rows each get their
verdict; an empty table gives an empty result; only ``doc_id``, ``text``, ``lang``
and ``source`` are read, other columns pass through ``filter_documents`` whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfold.llm.common import SPACES, let, quoted, small, words
from quantfold.tables import Stage

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_DOCS = 200
SPREAD = 3
#: Measure: whether it has a lower limit as well, and the slack of its limits (per mille). Symbols and repeats are rare, so
#: most sketches have no spread there: a document may always have a few symbols and repeat a third of its lines.
MEASURES = {"space_pm": (True, 30), "symbol_pm": (False, 20), "dup_line_pm": (False, 350)}


def repeated_words(word_list: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the list.

    Windows are compared by 64-bit hash within one text.
    """
    hashes = F.when(
        F.size(word_list) >= width,
        F.transform(
            F.sequence(F.lit(0), F.size(word_list) - width),
            lambda i: F.xxhash64(*[F.get(word_list, i + k) for k in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hs: Column) -> Column:
        placed = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(width)), F.lit(width)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        counted = let(let(placed, positions), total)
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(counted)

    return let(hashes, covered).cast("long")


def cheap_measures() -> dict[str, Column]:
    """Measures that the sketches need; no word list is built for them."""
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return {
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "_lines": lines,
    }


def with_measures(df: DataFrame) -> DataFrame:
    """Adds word_chars, n_symbols, n_dup_lines and the measures of the sketches."""
    lines = F.col("_lines")
    return (
        df.withColumns(cheap_measures())
        .withColumns({"n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"), "_n_lines": F.size(lines), "_n_chars": F.length(F.coalesce("text", F.lit("")))})
        .withColumns(
            {
                "space_pm": F.expr("(_n_chars - word_chars) * 1000 div greatest(_n_chars, 1)"),
                "symbol_pm": F.expr("n_symbols * 1000 div greatest(word_chars, 1)"),
                "dup_line_pm": F.expr("n_dup_lines * 1000 div greatest(_n_lines, 1)"),
            }
        )
        .drop("_lines", "_n_lines", "_n_chars")
    )


def with_base(df: DataFrame) -> DataFrame:
    """Adds n_words, n_repeat_words and base_failed."""
    return (
        df.withColumn("_words", words(F.col("text")))
        .withColumns({"n_words": F.size("_words").cast("long"), "n_repeat_words": let(F.col("_words"), lambda w: repeated_words(w))})
        .drop("_words")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def sketch_bin(value: Column) -> Column:
    """Lower edge of the bin of a value from 0 to 1000."""
    out = value - value % 16
    for edge, step in ((512, 8), (256, 4), (128, 2), (64, 1)):
        out = F.when(value < edge, value - value % step).otherwise(out)
    return out


def sketches(measured: DataFrame, names: list[str]) -> DataFrame:
    """Counts per (lang, source, measure, bin): the mergeable part."""
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), sketch_bin(F.col(n)).alias("bin")) for n in names]))
    return measured.select("lang", "source", stacked.alias("m")).groupBy("lang", "source", "m.measure", "m.bin").agg(F.count("*").alias("n"))


def limits(bins: DataFrame, measures: dict[str, tuple[bool, int]] = MEASURES, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (lang, source) with ``<measure>_least``, ``<measure>_limit`` and the level of the sketch used (2: source, 1: language, 0: all)."""
    levels = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    owner = {"l": F.when(F.col("level") >= 1, F.col("lang")), "s": F.when(F.col("level") >= 2, F.col("source"))}
    merged = bins.withColumn("level", levels).withColumns(owner).groupBy("level", "l", "s", "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("level", "l", "s", "measure")
    ranked = merged.withColumns(
        {"up_to": F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(group)}
    )
    quartile = lambda k: F.min(F.when(4 * F.col("up_to") >= k * F.col("total"), F.col("bin")))
    fences = ranked.groupBy("level", "l", "s", "measure").agg(quartile(1).alias("low"), quartile(3).alias("high"), F.max("total").alias("total"))
    of = lambda pick: F.element_at(F.create_map(*[F.lit(x) for n, m in measures.items() for x in (n, pick(m))]), F.col("measure"))
    own = F.when(of(lambda m: m[0]), F.lit(0)).otherwise(F.call_function("div", F.col("high"), F.lit(4)))
    reach = SPREAD * (F.col("high") - F.col("low")) + of(lambda m: m[1]) + own
    least = F.when(of(lambda m: m[0]), F.greatest(F.col("low") - reach, F.lit(0))).otherwise(F.lit(0))
    fences = fences.withColumns({"least": least, "limit": F.col("high") + reach})
    one = lambda n, c: F.max(F.when(F.col("measure") == n, F.col(c))).alias(f"{n}_{c}")
    per_level = fences.groupBy("level", "l", "s").agg(F.max("total").alias("total"), *[one(n, c) for n in measures for c in ("least", "limit")])
    per_level = per_level.filter((F.col("level") == 0) | (F.col("total") >= min_docs))
    # each group meets its three sketches by key
    wanted = bins.select("lang", "source").distinct().withColumn("level", levels).withColumns(owner).alias("w")
    same = (F.col("w.level") == F.col("p.level")) & F.col("w.l").eqNullSafe(F.col("p.l")) & F.col("w.s").eqNullSafe(F.col("p.s"))
    met = wanted.join(per_level.alias("p"), same).groupBy("w.lang", "w.source").agg(
        *[F.max(F.when(F.col("w.level") == k, F.struct(*[f"p.{n}_{c}" for n in measures for c in ("least", "limit")]))).alias(f"f{k}") for k in range(3)]
    )
    out = {}
    for n in measures:
        low, high = F.col(f"f0.{n}_least"), F.col(f"f0.{n}_limit")
        for k in (1, 2):
            width = high - low
            low, high = F.coalesce(F.greatest(f"f{k}.{n}_least", F.when(F.col(f"f{k}").isNotNull(), low - width)), low), F.coalesce(F.least(f"f{k}.{n}_limit", F.when(F.col(f"f{k}").isNotNull(), high + width)), high)
        out |= {f"{n}_least": low, f"{n}_limit": high}
    level = F.when(F.col("f2").isNotNull(), 2).when(F.col("f1").isNotNull(), 1).otherwise(0)
    return met.select("lang", "source", level.alias("sketch_level"), *[v.alias(k) for k, v in out.items()])


def quality_rules(docs: DataFrame, measures: dict[str, tuple[bool, int]] = MEASURES, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, the base measures, base_failed, the method's measures and limits, kept."""
    return _judged(docs.select("doc_id", "text", "lang", "source"), measures, min_docs).drop("text")


def filter_documents(docs: DataFrame, measures: dict[str, tuple[bool, int]] = MEASURES, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"))
    told = whole.select("doc", *[F.col("doc").getField(c).alias(c) for c in ("text", "lang", "source")])
    return _judged(told, measures, min_docs).filter("kept").select("doc.*")


def _judged(docs: DataFrame, measures: dict[str, tuple[bool, int]], min_docs: int) -> DataFrame:
    names = list(measures)
    bins = Stage(docs.sparkSession, "quality").plain("sketches", sketches(with_measures(docs.select("text", "lang", "source")), names))
    of_group = small(limits(bins, measures, min_docs).withColumnsRenamed({"lang": "of_lang", "source": "of_source"}))
    judged = with_base(with_measures(docs))
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    within = F.lit(True)
    for n in names:
        within = within & F.col(n).between(F.col(f"{n}_least"), F.col(f"{n}_limit"))
    # one expression over both sides, so that a filter on it stays above the join and measures are taken once
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(within)
    return judged.join(of_group, same, "left").withColumn("kept", kept).drop("of_lang", "of_source")
