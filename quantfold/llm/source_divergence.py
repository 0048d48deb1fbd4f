"""How far the sources of a language differ in their terms, by iceberg prefix refinement.

Terms are runs of letters (A-Z lowered, everything beyond ASCII counts as a letter). A
language keeps the terms that at least ``least_docs`` of its documents contain. They are
found from byte prefixes: a level counts the documents that hold each prefix of
``width`` bytes, prefixes in fewer documents are discarded, and the next level looks
only at words that go on from a kept prefix, at twice the width. A word that ends within
the width is complete; its level counts its documents and occurrences per source at
once. Levels go on until no prefix is left to extend. A level is one pass over the texts
that gathers a row per prefix and 8 MB of text, added up by Spark. Kept prefixes reach
the next pass as a bit map of fixed size: a bit set by chance only lets a prefix be
counted that its own count then discards.

Counts give each (language, source) and each language a score per kept term,
``1 + floor(scale * (count + smooth) / (N + smooth * V))``, N the group's occurrences and V
the kept terms. Scores are integers; nothing is rounded otherwise. The sums of absolute
differences of all pairs of sources are made in blocks of terms (dealt by hash) and
tiles of sources, as matrices of bounded size, and added up.

Defined cases: null text, lang and source are ''; every row is a document of its own, so
repeated rows count again; a text without letters has no terms, its group is still
reported; with no kept terms all pairs have value 0; an empty table gives an empty
result; other columns are not read. A text is held whole by one task (about 40 bytes
of memory per byte of text).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfold.llm import bitmap, wordscan
from quantfold.llm.common import small
from quantfold.tables import Stage

FIRST_WIDTH = 4
CHUNK_BYTES = 8 << 20
TILE = 200
BLOCK_CELLS = 1 << 14
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
COUNTED = "lang string, source string, term binary, whole boolean, n_docs long, n_occurrences long"


def _term_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes (with zeros between the texts), and start, length and row of each term."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    data = _LOWER[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
    edge = np.diff(LETTERS[data].view(np.int8), prepend=0)
    start = np.flatnonzero(edge == 1)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw[:-1]], dtype=np.int64)))
    return data, start, np.flatnonzero(edge == -1) - start, np.searchsorted(begins, start, side="right") - 1


def _prefixes(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """First ``width`` bytes of each term, zero beyond its end, as rows of bytes."""
    step = np.arange(width)
    at = np.minimum(start[:, None] + step, len(data) - 1)
    return np.where(step < length[:, None], data[at], 0).astype(np.uint8)


def _place(prefixes: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Place in the bit map of each (language, prefix)."""
    wide = np.zeros((len(prefixes), -(-prefixes.shape[1] // 8) * 8), np.uint8)
    wide[:, : prefixes.shape[1]] = prefixes
    at = lang.copy()
    for part in wide.view(np.uint64).T:
        at = wordscan.mix((at ^ part) * np.uint64(0x9E3779B97F4A7C15))
    return (at & np.uint64(bitmap.BITS - 1)).astype(np.int64)


def _lang_number(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _chunk_counts(langs: list[str], sources: list[str], texts: pa.Array, kept: np.ndarray, parent: int, width: int) -> pa.RecordBatch:
    data, start, length, row = _term_runs(texts)
    names = sorted(set(langs))
    lang_of = np.array([names.index(n) for n in langs], np.int64)
    if parent:
        longer = length > parent
        start, length, row = start[longer], length[longer], row[longer]
        numbers = np.array([_lang_number(n) for n in names], np.uint64)
        on = bitmap.has(kept, _place(_prefixes(data, start, np.full(len(start), parent), parent), numbers[lang_of[row]]))
        start, length, row = start[on], length[on], row[on]
    prefixes = _prefixes(data, start, length, width)
    whole = length <= width
    if width <= 8:
        found, of = np.unique(np.ascontiguousarray(prefixes).view(f">u{width}").ravel().astype(np.uint64), return_inverse=True)
        found = found.astype(f">u{width}").view(f"S{width}")
    else:
        found, of = np.unique(np.ascontiguousarray(prefixes).view(f"S{width}").ravel(), return_inverse=True)
    groups = sorted(set(zip(langs, sources)))
    number = {g: i for i, g in enumerate(groups)}
    group_of = np.array([number[g] for g in zip(langs, sources)], np.int64)
    # per document, then per group: whole terms by language and source, prefixes by language
    wide = max(1, 2 * len(found))
    in_doc, times = np.unique(row * wide + whole * len(found) + of, return_counts=True)
    doc, key = in_doc // wide, in_doc % wide
    group = np.where(key >= len(found), group_of[doc], len(groups) + lang_of[doc])
    both, at, n_docs = np.unique(group * wide + key, return_inverse=True, return_counts=True)
    n_occurrences = np.bincount(at, times, len(both)).astype(np.int64)
    group, key = both // wide, both % wide
    owner = [*groups, *[(n, None) for n in names]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([g[0] for g in owner], pa.string()).take(pa.array(group)), pa.array([g[1] for g in owner], pa.string()).take(pa.array(group)),
            pa.array(found.tolist(), pa.binary()).take(pa.array(key % max(1, len(found)))), pa.array(key >= len(found)), pa.array(n_docs.astype(np.int64)), pa.array(n_occurrences),
        ],
        names=["lang", "source", "term", "whole", "n_docs", "n_occurrences"],
    )


def _level(docs: DataFrame, kept: np.ndarray, parent: int, width: int) -> DataFrame:
    """Counts of the complete terms of more than ``parent`` bytes and of the prefixes of ``width`` bytes of longer ones, under kept prefixes."""
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def count(batches):
        for b in batches:
            for lo, hi in wordscan.chunks(b.column(2), CHUNK_BYTES):
                part = b.slice(lo, hi - lo)
                yield _chunk_counts(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), shared.value, parent, width)

    found = docs.select("lang", "source", "text").mapInArrow(count, COUNTED)
    return found.groupBy("lang", "source", "term", "whole").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_occurrences").alias("n_occurrences"))


def _places_of(batch: pa.RecordBatch) -> np.ndarray:
    langs = batch.column(0).to_pylist()
    terms = batch.column(1).to_pylist()
    prefixes = np.frombuffer(b"".join(terms), np.uint8).reshape(len(terms), -1)
    return _place(prefixes, np.array([_lang_number(n) for n in langs], np.uint64))


def term_counts(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """lang, source, term, n (occurrences, above 0) of the terms in at least ``least_docs`` documents of their language."""
    stage = Stage(docs.sparkSession, "terms")
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    complete, kept, parent, width = None, np.zeros(0, np.uint8), 0, FIRST_WIDTH
    while not parent or len(kept):
        counted = stage.plain(f"level{width}", _level(docs, kept, parent, width))
        whole = counted.filter("whole").select("lang", "source", "term", "n_docs", F.col("n_occurrences").alias("n"))
        complete = whole if complete is None else complete.unionByName(whole)
        # prefixes are counted per language
        kept = bitmap.filled(counted.filter(~F.col("whole") & (F.col("n_docs") >= least_docs)).select("lang", "term"), _places_of)
        parent, width = width, 2 * width
    enough = complete.groupBy("lang", "term").agg(F.sum("n_docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term")
    counts = complete.join(enough, ["lang", "term"], "left_semi")
    return stage.plain("counts", counts.select("lang", "source", F.col("term").cast("string").alias("term"), "n"))


def _score(n: Column, total: Column, terms: Column, scale: int, smooth: int) -> Column:
    top = F.lit(scale).cast("decimal(20,0)") * (n + smooth).cast("decimal(18,0)")
    return F.lit(1) + F.call_function("div", top, F.nullif(total + smooth * terms, F.lit(0)).cast("decimal(38,0)"))


def _pair_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of differences of all pairs of sources of one block; rows without a term hold what a source gives to absent terms."""
    base = rows[rows["term"].isna()].sort_values("source").drop_duplicates("source")
    names, tiles, zero = base["source"].to_numpy(object), base["tile"].to_numpy(), base["p"].to_numpy(np.int64)
    held = rows[rows["term"].notna()]
    at, terms = pd.factorize(held["term"])
    scores = np.repeat(zero[None, :], len(terms), axis=0)
    scores[at, np.searchsorted(names, held["source"].to_numpy(object))] = held["p"].to_numpy(np.int64)
    one, two = key[2], key[3]
    a, b, apart, absent = [], [], [], []
    for i in range(len(names)):
        # a pair within one tile is taken once, where the block is that tile with itself
        others = np.flatnonzero((np.arange(len(names)) > i) & ((tiles != tiles[i]) | (one == two)))
        a += [names[i]] * len(others)
        b += names[others].tolist()
        apart += np.abs(scores[:, others] - scores[:, [i]]).sum(axis=0).tolist()
        absent += np.abs(zero[others] - zero[i]).tolist()
    return pd.DataFrame({"lang": pd.Series([key[0]] * len(a), dtype=object), "a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object), "apart": apart, "n_terms": len(terms), "absent": absent})


def _pairs(groups: DataFrame, scored: DataFrame) -> DataFrame:
    """lang, source, item, value for all pairs of sources of a language, both ways."""
    sized = groups.groupBy("lang").agg(F.count("*").alias("n_sources"), F.first("terms").alias("terms"))
    tiles = F.ceil(F.col("n_sources") / TILE).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.least("n_sources", F.lit(2 * TILE)) / BLOCK_CELLS)).cast("int")
    sized = small(sized.withColumns({"tiles": tiles, "blocks": blocks}).select("lang", "tiles", "blocks"))
    own = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    dealt = lambda df: df.join(sized, "lang").withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    by_tiles = ["lang", "block", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "source", "tile", "term", "p"]
    base = dealt(groups.select("lang", "source", F.coalesce("absent", F.lit(0).cast("long")).alias("p"))).withColumn("term", F.lit(None).cast("string"))
    base = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*by_tiles)
    terms = dealt(scored.select("lang", "source", "term", "p")).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).select(*by_tiles)
    sums = base.unionByName(terms).groupBy("lang", "block", "one", "two").applyInPandas(_pair_sums, "lang string, a string, b string, apart long, n_terms long, absent long")
    total = sums.groupBy("lang", "a", "b").agg(F.sum("apart").alias("apart"), F.sum("n_terms").alias("n_terms"), F.max("absent").alias("absent"))
    total = total.join(small(groups.groupBy("lang").agg(F.first("terms").alias("terms"))), "lang")
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    value = F.col("apart") + (F.col("terms") - F.col("n_terms")) * F.col("absent")
    return total.select("lang", ends.alias("e"), value.alias("value")).select("lang", "e.source", "e.item", "value")


def source_divergence(docs: DataFrame, least_docs: int = 30, scale: int = 10**9, smooth: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of the language by the sum of score differences (``pair``),
    and the ``top`` terms that the source has more of than its language (``term``)."""
    stage = Stage(docs.sparkSession, "divergence")
    counts = term_counts(docs, least_docs)
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    of_lang = small(stage.plain("langs", by_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "total_lang"])
    groups = stage.plain("groups", groups.withColumn("absent", _score(F.lit(0), F.col("total"), F.col("terms"), scale, smooth)))
    scored = counts.join(small(groups), ["lang", "source"]).withColumn("p", _score(F.col("n"), F.col("total"), F.col("terms"), scale, smooth))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(groups, scored).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    q = _score(F.col("n_lang"), F.col("total_lang"), F.col("terms"), scale, smooth)
    more = scored.join(by_lang, ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0")
    terms = more.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*out).unionByName(terms.select(*out))
