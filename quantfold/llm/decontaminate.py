"""Benchmark decontamination as a prefix-filtered join of word windows.

An item's windows are its runs of ``width`` consecutive words (an item of fewer
words, but not none, is one window). A window occurs in a document where at least
``containment`` of its words stand in their places in a run of equal length. Of the
``width`` words at least one of the ``width - need + 1`` rarest must then be among
the matching ones, so only those prefix words are joined with the documents' words;
the rarity is counted over all documents. A joined word fixes where the window would
begin, which must lie inside the document together with its end (positional and length
bounds); what is left is verified word by word.

Items are taken in blocks of at most ``BLOCK_BYTES`` of text; a block's index is
broadcast, and further blocks are further passes over the same rows, so benchmarks of
any size are whole and no document is shuffled.

Defined cases: a null or empty text has no words; an item without words or without an
id is left out; items that repeat an id are one item with the windows of all its texts;
repeated documents are kept; an empty benchmark hits nothing; an empty table gives an
empty result; other columns are not read. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantfold.llm import wordscan

WIDTH = 10
BLOCK_BYTES = 16 << 20
COUNT_PARTS = 8


class Index:
    """Windows of one block of items, and the postings of their prefix words."""

    def __init__(self, ids: list[str], texts: list[str], width: int):
        self.ids = ids
        words = wordscan.scan(pa.array(texts, pa.large_string()), wordscan.NOT_ALNUM)
        self.vocabulary, place = np.unique(words.hash, return_inverse=True)
        found: dict[tuple[int, ...], int] = {}
        owners: list[set[int]] = []
        for r in range(words.rows):
            own = place[words.of(r)]
            for i in range(max(1, len(own) - width + 1) if len(own) else 0):
                at = found.setdefault(tuple(own[i : i + width].tolist()), len(found))
                if at == len(owners):
                    owners.append(set())
                owners[at].add(r)
        self.windows = [np.array(w) for w in found]
        self.owners = [sorted(o) for o in owners]
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are item words, and which words they are."""
        at = np.flatnonzero(self.near[(hashes >> np.uint64(48)).astype(np.int64)])
        word = np.searchsorted(self.vocabulary, hashes[at])
        word[word == len(self.vocabulary)] = 0
        same = self.vocabulary[word] == hashes[at] if len(self.vocabulary) else np.zeros(0, bool)
        return at[same], word[same]

    def join_on(self, counts: np.ndarray, containment: float) -> None:
        """Chooses the prefix words by their counts in the corpus."""
        entries = []
        self.need = np.array([max(1, int(np.ceil(containment * len(w) - 1e-9))) for w in self.windows])
        for k, w in enumerate(self.windows):
            rare = np.lexsort((np.arange(len(w)), w, counts[w]))[: len(w) - self.need[k] + 1]
            entries += [(w[o], k, o) for o in rare]
        table = np.array(sorted(entries), np.int64).reshape(-1, 3)
        self.first = np.searchsorted(table[:, 0], np.arange(len(self.vocabulary) + 1))
        self.window, self.offset = table[:, 1], table[:, 2]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        width = int(self.length.max()) if len(self.length) else 1
        self.words = np.zeros((len(self.windows), width), np.uint64)
        for k, w in enumerate(self.windows):
            self.words[k, : len(w)] = self.vocabulary[w]

    def hits(self, words: wordscan.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word (from the start of the scan) and window of every occurrence."""
        at, word = self.known(words.hash)
        n = self.first[word + 1] - self.first[word]
        at, word, n = at[n > 0], word[n > 0], n[n > 0]
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, none
        entry = np.arange(int(n.sum())) + np.repeat(self.first[word] - (np.cumsum(n) - n), n)
        window = self.window[entry]
        row = np.searchsorted(words.first, at, side="right") - 1
        row, start = np.repeat(row, n), np.repeat(at, n) - self.offset[entry]
        fits = (start >= words.first[row]) & (start + self.length[window] <= words.first[row + 1])
        row, start, window = row[fits], start[fits], window[fits]
        matching = np.zeros(len(start), np.int64)
        for k in range(self.words.shape[1]):
            inside = k < self.length[window]
            place = np.minimum(start + k, len(words.hash) - 1)
            matching += inside & (words.hash[place] == self.words[window, k])
        ok = matching >= self.need[window]
        found = np.unique(np.stack([row[ok], start[ok], window[ok]]), axis=1)
        return found[0], found[1], found[2]


def _counts(docs: DataFrame, index: Index) -> np.ndarray:
    """Occurrences of the block's words in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches):
        index = shared.value
        total = np.zeros(len(index.vocabulary), np.int64)
        for b in batches:
            texts = b.column(0)
            for lo, hi in wordscan.chunks(texts):
                _, word = index.known(wordscan.scan(texts.slice(lo, hi - lo), wordscan.NOT_ALNUM).hash)
                total += np.bincount(word, minlength=len(total))
        if total.any():
            yield wordscan.pack(total, COUNT_PARTS)

    counts = wordscan.merged(docs.select("text").mapInArrow(count, wordscan.PACKED), np.int64, COUNT_PARTS)
    return counts if len(counts) else np.zeros(len(index.vocabulary), np.int64)


def _joined(rows: pa.RecordBatch, index: Index, items: list[list[str]], spans: list[list[tuple[int, int]]], n_words: list[int]) -> None:
    """Adds a block's hits to the items and word spans of each row."""
    texts = rows.column(1)
    for lo, hi in wordscan.chunks(texts):
        words = wordscan.scan(texts.slice(lo, hi - lo), wordscan.NOT_ALNUM)
        n_words[lo:hi] = np.diff(words.first).tolist()
        for r, start, window in zip(*(x.tolist() for x in index.hits(words))):
            begin = start - int(words.first[r])
            spans[lo + r].append((begin, begin + int(index.length[window])))
            items[lo + r] += [index.ids[o] for o in index.owners[window]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: float = 1.0, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), spans (word ranges), items (ids as sorted strings).

    ``keep`` names columns of ``docs`` to pass on besides.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "n_words", "n_hit", "spans", "items")]
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    spans_type = "array<struct<begin:int,end:int>>"
    df = docs.select("doc_id", F.col("text").alias("_text"), F.lit(0).alias("n_words"), F.array().cast(spans_type).alias("spans"), F.array().cast("array<string>").alias("items"), *keep)
    schema = df.schema
    for block in range(n_blocks):
        taken = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()
        index = Index([r.item_id for r in taken], [r.text for r in taken], width)
        if not index.windows and n_blocks > 1:
            continue
        index.join_on(_counts(docs, index), containment)
        df = df.mapInArrow(_pass(docs.sparkSession.sparkContext.broadcast(index), block == n_blocks - 1), schema)
    return df.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"]).alias("n_hit"), "spans", "items", *keep,
    )


def _pass(shared, last: bool):
    def run(batches):
        index = shared.value
        for b in batches:
            before = [b.column(i).to_pylist() for i in (3, 4)]
            spans = [[(s["begin"], s["end"]) for s in row] for row in before[0]]
            items, n_words = [list(x) for x in before[1]], [0] * b.num_rows
            _joined(b, index, items, spans, n_words)
            spans = [[{"begin": x, "end": y} for x, y in _merged(row)] for row in spans]
            # the text is needed until the last block
            text = pa.nulls(b.num_rows, b.schema.field(1).type) if last else b.column(1)
            columns = [b.column(0), text, pa.array(n_words, pa.int32()), pa.array(spans, b.schema.field(3).type), pa.array([sorted(set(x)) for x in items], b.schema.field(4).type)]
            yield pa.RecordBatch.from_arrays(columns + [b.column(i) for i in range(5, b.num_columns)], names=b.schema.names)

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that hit no item, with all their columns."""
    kept = docs.columns
    held = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)])
    out = decontaminate(held, benchmark, width, keep=[f"_c{i}" for i in range(len(kept))])
    return out.filter("n_hit = 0").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)])
