"""Removes long word sequences that stand in an earlier document as well, by suffix automata of reference shards.

A window is ``width`` consecutive words of one document. A word goes if a window that
covers it also starts in a document with a smaller id. Windows are judged on the input.

1. Each window has an anchor: the least hash of its short n-grams. Equal windows have
   equal anchors. Consecutive windows of one anchor are one span of words (spans are cut
   where they get long). An anchor that only one document has is dropped.
2. Equal spans are one body, which keeps the smallest id that has it. Anchors with many
   different bodies (the borders of a passage that many documents share) go on window
   by window: windows that occur once are dropped where they are found, equal ones are one
   body, and a body gets their first documents by the runs of such windows that it has.
3. Bodies are reference and stream at once: shards hold the bodies of their anchors, a
   suffix automaton over the words of a shard knows for every substring the smallest id
   that has it, and every body runs through the automaton of its shard. Where its matching statistic
   reaches ``width``, the state gives the first document of that window.
4. A document's windows with a smaller first document are its removed spans.

The automata are not broadcast whole: their sum grows with the corpus. Anchors deal both the
reference and the documents' spans to the shard where they can meet, so each automaton goes to
one task and no document meets a shard with which it shares no anchor.
Texts are read three times; only texts that have bodies or removed spans are shuffled.

Defined cases: null, empty and short texts lose nothing; a null ``doc_id`` is not smaller than
another and has no smaller one, so the row loses nothing and is no reference; rows that
repeat an id count as documents of one id: they do not remove words of each other;
a window that repeats inside one document is kept; an empty table gives an empty
result; other columns are not read. Words are compared by 64-bit hashes. A text is held
whole by one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quantfold.llm import bitmap, wordscan
from quantfold.tables import Stage

ANCHOR = 16
#: Windows of one span, bodies of one anchor before it goes on by windows, words of a shard.
SPAN_WINDOWS = 64
MANY_BODIES = 200
SHARD_WORDS = 1 << 15

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[name]
    while len(have) < n:
        step = np.uint64(pow(int(base), len(have), 1 << 64))
        have = np.concatenate((have, have * step))
    _powers[name] = have
    return have[:n]


class Sequences:
    """Hashes of word sequences of any length in constant time."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _power("up", _BASE, n + 1)[:n], dtype=np.uint64)))
        self.back = _power("down", _INVERSE, n + 1)

    def hash(self, start: np.ndarray, n) -> np.ndarray:
        return wordscan.mix((self.sum[start + n] - self.sum[start]) * self.back[start] + np.asarray(n).astype(np.uint64))


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if width > have else out


@dataclass
class Spans:
    row: np.ndarray
    start: np.ndarray  # first word in its row
    n: np.ndarray  # words
    anchor: np.ndarray
    body: np.ndarray


def _spans(hashes: np.ndarray, first: np.ndarray, width: int, gram: int) -> Spans:
    """Spans of consecutive windows of one anchor, row by row."""
    none = np.zeros(0, np.int64)
    if len(hashes) < width:
        return Spans(none, none, none, none.view(np.uint64), none.view(np.uint64))
    made = Sequences(hashes)
    grams = made.hash(np.arange(len(hashes) - gram + 1), gram)
    anchors = _least_of(grams, width - gram + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(anchors)]
    at = np.flatnonzero(first[row + 1] - np.arange(len(anchors)) >= width)
    row, anchors = row[at], anchors[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    begins = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    begins = np.flatnonzero(place % SPAN_WINDOWS == 0)
    n = np.diff(np.append(begins, len(at))) + width - 1
    return Spans(row[begins], at[begins] - first[row[begins]], n, anchors[begins], made.hash(at[begins], n))


def spans_of(docs: DataFrame, width: int) -> DataFrame:
    """key, doc_id, start, n, anchor, body for the spans of all documents (key, doc_id, text)."""
    fields = [docs.schema["key"], docs.schema["doc_id"]]
    out = StructType([*fields, StructField("start", IntegerType()), StructField("n", IntegerType()), StructField("anchor", LongType()), StructField("body", LongType())])

    def find(batches):
        for b in batches:
            for lo, hi in wordscan.chunks(b.column(2)):
                part = b.slice(lo, hi - lo)
                words = wordscan.scan(part.column(2), fold=False)
                s = _spans(words.hash, words.first, width, min(ANCHOR, width))
                rows = pa.array(s.row)
                columns = [part.column(0).take(rows), part.column(1).take(rows), pa.array(s.start.astype(np.int32)), pa.array(s.n.astype(np.int32)), pa.array(s.anchor.view(np.int64)), pa.array(s.body.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    return docs.mapInArrow(find, out)


def _place(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False) & (bitmap.BITS - 1)


def _touched(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose key may be among ``keys``; the map has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.filled(keys.select("key"), _place))

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(bitmap.has(shared.value, _place(b))))

    return docs.mapInArrow(keep, docs.schema)


def _with_words(docs: DataFrame, bodies: DataFrame) -> DataFrame:
    """``bodies`` (anchor, body, n, first: doc_id, key, start) as anchor, body, n, first_id, words (hashes), read from the text of ``first``."""
    wanted = bodies.select("first.key", "first.doc_id", F.struct("anchor", "body", "n", F.col("first.start").alias("start")).alias("s")).groupBy("key", "doc_id").agg(F.collect_list("s").alias("spans"))
    held = _touched(docs, wanted).dropDuplicates(["key", "doc_id"]).join(wanted, ["key", "doc_id"]).select("doc_id", "text", "spans")
    out = StructType([StructField("anchor", LongType()), StructField("body", LongType()), StructField("n", IntegerType()), StructField("first_id", docs.schema["doc_id"].dataType), StructField("words", ArrayType(LongType()))])

    def cut(batches):
        for b in batches:
            for lo, hi in wordscan.chunks(b.column(1)):
                part = b.slice(lo, hi - lo)
                words = wordscan.scan(part.column(1), fold=False)
                rows, anchors, bodies, ns, cuts = [], [], [], [], []
                for r, spans in enumerate(part.column(2).to_pylist()):
                    own = words.hash[words.of(r)].view(np.int64)
                    for s in spans:
                        rows.append(r)
                        anchors.append(s["anchor"])
                        bodies.append(s["body"])
                        ns.append(s["n"])
                        cuts.append(own[s["start"] : s["start"] + s["n"]])
                flat = pa.array(np.concatenate(cuts) if cuts else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ns, dtype=np.int64))).astype(np.int32)), flat)
                columns = [pa.array(anchors, pa.int64()), pa.array(bodies, pa.int64()), pa.array(ns, pa.int32()), part.column(0).take(pa.array(rows, pa.int64())), lists]
                yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    return held.mapInArrow(cut, out)


class Automaton:
    """Suffix automaton of several word sequences; each state knows the smallest owner of its substrings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner: list = [None]

    def add(self, words: list, owner) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            to = nexts[last].get(w)
            if to is None:
                state, at = len(nexts), last
                nexts.append({})
                link.append(0)
                length.append(length[last] + 1)
                self.owner.append(None)
                while at >= 0 and w not in nexts[at]:
                    nexts[at][w] = state
                    at = link[at]
                if at >= 0:
                    link[state] = self._ending(at, w)
                last = state
            else:
                last = self._ending(last, w)
            if self.owner[last] is None or owner < self.owner[last]:
                self.owner[last] = owner

    def _ending(self, at: int, w) -> int:
        """The state of the string of ``at`` followed by ``w``, split off if its state also holds longer ones."""
        nexts, link, length = self.next, self.link, self.length
        to = nexts[at][w]
        if length[to] == length[at] + 1:
            return to
        copy = len(nexts)
        nexts.append(dict(nexts[to]))
        link.append(link[to])
        length.append(length[at] + 1)
        self.owner.append(None)
        link[to] = copy
        while at >= 0 and nexts[at].get(w) == to:
            nexts[at][w] = copy
            at = link[at]
        return copy

    def close(self) -> None:
        """Hands owners on to the states of suffixes, longest first."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if up > 0 and self.owner[s] is not None and (self.owner[up] is None or self.owner[s] < self.owner[up]):
                self.owner[up] = self.owner[s]

    def first_owners(self, words: list, width: int) -> list:
        """Of each window of ``width`` words its smallest owner (None where the matching statistic is shorter)."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for i, w in enumerate(words):
            while state and w not in nexts[state]:
                state = link[state]
                matched = length[state]
            if w in nexts[state]:
                state = nexts[state][w]
                matched += 1
            while length[link[state]] >= width:
                state = link[state]
                matched = length[state]
            if i + 1 >= width:
                out.append(self.owner[state] if matched >= width else None)
        return out


def _firsts(bodies: DataFrame, width: int) -> DataFrame:
    """anchor, body, n, firsts (smallest id of each window) of bodies (anchor, body, n, first_id, words), through the automata of their shards."""
    spark = bodies.sparkSession
    words = bodies.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-int(words) // SHARD_WORDS))
    dealt = bodies.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(shards, shards // 64 + 1))
    dealt = dealt.repartition(tasks, "shard").sortWithinPartitions("shard").select("shard", "anchor", "body", "n", "first_id", "words")
    out = StructType([*[bodies.schema[c] for c in ("anchor", "body", "n")], StructField("firsts", ArrayType(bodies.schema["first_id"].dataType))])
    types = [pa.int64(), pa.int64(), pa.int32()]
    ids = pa.list_(to_arrow_type(bodies.schema["first_id"].dataType))

    def through(held: list) -> pa.RecordBatch:
        automaton = Automaton()
        for anchor, body, n, owner, words in held:
            automaton.add(words, owner)
        automaton.close()
        columns = [pa.array([h[i] for h in held], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([automaton.first_owners(h[4], width) for h in held], ids)], names=out.fieldNames())

    def run(batches):
        shard, held = None, []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if held and row[0] != shard:
                    yield through(held)
                    held = []
                shard = row[0]
                held.append(row[1:])
        if held:
            yield through(held)

    return dealt.mapInArrow(run, out)


def _words_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Words of a batch of bodies, and where each row begins in them."""
    lists = b.column(b.schema.get_field_index("words"))
    return lists.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)


def _window_hashes(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of each window of a batch of bodies."""
    flat, first = _words_of(b)
    s = _spans(flat, first, width, width)
    # one window of its own each, but for repeats in a row
    count = s.n - width + 1
    at = np.repeat(s.start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(s.row, count), at, np.repeat(s.anchor, count)


def _windows(bodies: DataFrame, width: int, kept: Callable[[list, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """window (hash), k, first_id, anchor, body, n, at for the windows of the bodies that ``kept`` (their bodies' ids by row, rows, hashes) picks, with their counts."""
    names = ("first_id", "anchor", "body", "n")
    out = StructType([StructField("window", LongType()), StructField("k", LongType()), *[bodies.schema[c] for c in names], StructField("at", IntegerType())])

    def split(batches):
        for b in batches:
            row, at, window = _window_hashes(b, width)
            picked, k = kept(b.column(b.schema.get_field_index("first_id")).to_pylist(), row, window)
            take = pa.array(row[picked])
            columns = [pa.array(window[picked].view(np.int64)), pa.array(k), *[b.column(b.schema.get_field_index(c)).take(take) for c in names], pa.array(at[picked].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    return bodies.mapInArrow(split, out)


def _marked(bits: np.ndarray, window: np.ndarray) -> np.ndarray:
    return bitmap.has(bits, window.view(np.int64) & (bitmap.BITS - 1))


def _once_a_batch(ids: list, row: np.ndarray, window: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each different window among those at ``at`` the place with the smallest id, and how often it is there."""
    rank = np.empty(len(ids), np.int64)
    rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    order = at[np.lexsort((rank[row[at]], window[at]))]
    _, begin, k = np.unique(window[order], return_index=True, return_counts=True)
    return order[begin], k.astype(np.int64)


def _all_windows(ids: list, row: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(window)), np.ones(len(window), np.int64)


def _runs(bodies: DataFrame, width: int, bits) -> DataFrame:
    """run (hash of its words), words (their number), anchor, body, n, at (its first window) for each stretch of windows of a body that are marked in ``bits``."""
    names = ("anchor", "body", "n")
    out = StructType([StructField("run", LongType()), StructField("words", IntegerType()), *[bodies.schema[c] for c in names], StructField("at", IntegerType())])

    def stretches(batches):
        for b in batches:
            flat, first = _words_of(b)
            row, at, window = _window_hashes(b, width)
            picked = np.flatnonzero(_marked(bits.value, window))
            row, at = row[picked], at[picked]
            new = np.ones(len(picked), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            begins = np.flatnonzero(new)
            words = np.diff(np.append(begins, len(picked))) + width - 1
            row, at = row[begins], at[begins]
            run = Sequences(flat).hash(first[row] + at, words)
            take = pa.array(row)
            columns = [pa.array(run.view(np.int64)), pa.array(words.astype(np.int32)), *[b.column(b.schema.get_field_index(c)).take(take) for c in names], pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    return bodies.mapInArrow(stretches, out)


def _firsts_by_window(bodies: DataFrame, width: int, stage: Stage) -> DataFrame:
    """The same as ``_firsts`` for bodies of common anchors: windows found once are settled by their body alone, the others are bodies of their own.

    A window that is found once does not leave the task that reads its body, and the others go back to their bodies in runs."""
    twice = bodies.sparkSession.sparkContext.broadcast(bitmap.repeated(bodies.select("words"), lambda b: _window_hashes(b, width)[2].view(np.int64) & (bitmap.BITS - 1)))

    def met(ids, row, window):
        return _once_a_batch(ids, row, window, np.flatnonzero(_marked(twice.value, window)))

    counted = _windows(bodies, width, met).groupBy("window").agg(F.sum("k").alias("k"), F.min(F.struct("first_id", "anchor", "body", "n", "at")).alias("o"))
    carriers = counted.filter("k > 1").select("window", "o.*")
    texts = carriers.join(bodies.select("anchor", "body", "n", "words"), ["anchor", "body", "n"])
    own = texts.select(F.col("window").alias("anchor"), F.col("window").alias("body"), F.lit(width).cast("int").alias("n"), "first_id", F.slice("words", F.col("at") + 1, F.lit(width)).alias("words"))
    solved = stage.plain("window_firsts", _firsts(stage.plain("window_texts", own), width)).select(F.col("anchor").alias("window"), F.get("firsts", F.lit(0)).alias("found"))
    bits = bodies.sparkSession.sparkContext.broadcast(bitmap.filled(solved, _place))

    runs = stage.plain("runs", _runs(bodies, width, bits))
    kinds = runs.groupBy("run", F.col("words").alias("k")).agg(F.min(F.struct("anchor", "body", "n", "at")).alias("o")).select("run", "k", "o.*")
    kinds = kinds.join(bodies.select("anchor", "body", "n", "first_id", "words"), ["anchor", "body", "n"])
    kinds = kinds.select(F.col("run").alias("anchor"), F.col("run").alias("body"), F.col("k").alias("n"), "first_id", F.slice("words", F.col("at") + 1, F.col("k")).alias("words"))
    found = _windows(kinds, width, _all_windows).join(solved, "window").groupBy(F.col("anchor").alias("run"), F.col("n").alias("words"))
    found = found.agg(F.collect_list(F.struct("at", "found")).alias("found"))
    moved = F.transform("found", lambda f: F.struct(F.col("at") + f["at"], f["found"]))
    earlier = runs.join(found, ["run", "words"]).groupBy("anchor", "body", "n").agg(F.map_from_entries(F.flatten(F.collect_list(moved))).alias("found"))
    places = F.sequence(F.lit(0), F.col("n") - width)
    firsts = F.transform(places, lambda at: F.coalesce(F.try_element_at("found", at), "first_id"))
    return bodies.join(earlier, ["anchor", "body", "n"], "left").select("anchor", "body", "n", firsts.alias("firsts"))


def repeated_spans(docs: DataFrame, width: int) -> DataFrame:
    """key, doc_id, spans (array of [lo, hi) in words, to be removed) of the documents (key, doc_id, text) that have some."""
    stage = Stage(docs.sparkSession, "substrings")
    named = docs.filter(F.col("doc_id").isNotNull())
    spans = stage.plain("spans", spans_of(named, width))
    shared = spans.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    spans = stage.plain("shared", spans.join(shared.select("anchor"), "anchor", "left_semi"))
    bodies = spans.groupBy("anchor", "body", "n").agg(F.min(F.struct("doc_id", "key", "start")).alias("first"))
    bodies = stage.plain("bodies", _with_words(named, bodies))
    many = bodies.groupBy("anchor").count().filter(F.col("count") > MANY_BODIES).select("anchor")
    firsts = _firsts(bodies.join(many, "anchor", "left_anti"), width).unionByName(_firsts_by_window(stage.plain("many", bodies.join(many, "anchor", "left_semi")), width, stage))
    firsts = stage.plain("firsts", firsts)
    # only bodies that some document has later than another
    met = spans.join(firsts, ["anchor", "body", "n"]).filter(F.col("doc_id") > F.array_min("firsts"))
    removed = F.transform("firsts", lambda f: F.coalesce(f < F.col("doc_id"), F.lit(False)))
    met = met.select("key", "doc_id", "start", removed.alias("gone"))
    is_gone = lambda i: F.coalesce(F.get("gone", i), F.lit(False))
    places = F.sequence(F.lit(0), F.size("gone") - 1)
    opens = F.filter(places, lambda i: is_gone(i) & ~F.coalesce(F.when(i > 0, F.get("gone", i - 1)), F.lit(False)))
    closes = F.filter(places, lambda i: is_gone(i) & ~is_gone(i + 1))
    pieces = F.zip_with(opens, closes, lambda a, b: F.struct((F.col("start") + a).alias("lo"), (F.col("start") + b + width).alias("hi")))
    return met.select("key", "doc_id", F.explode(pieces).alias("span")).groupBy("key", "doc_id").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for each row."""
    stage = Stage(docs.sparkSession, "repeats")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = stage.plain("removed", repeated_spans(keyed, width))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap.filled(spans.select("key"), _place))
    out = StructType([docs.schema["doc_id"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])

    def whole(batches):
        for b in batches:
            b = b.filter(pa.array(~bitmap.has(bits.value, _place(b))))
            for lo, hi in wordscan.chunks(b.column(2)):
                words = [t.split() for t in b.column(2).slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                yield answer(b.column(1).slice(lo, hi - lo), [len(w) for w in words], [0] * len(words), [b" ".join(w) for w in words])

    def cut(batches):
        for b in batches:
            n, removed, kept = [], [], []
            for text, gone in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                words = text.split()
                stays = np.ones(len(words), bool)
                for s in gone or []:
                    stays[s["lo"] : s["hi"]] = False
                n.append(len(words))
                removed.append(int((~stays).sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays)]))
            yield answer(b.column(0), n, removed, kept)

    def answer(ids, n, removed, kept):
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=out.fieldNames())

    same = (F.col("d.key") == F.col("s.key")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))
    touched = _touched(keyed, spans).alias("d").join(spans.alias("s"), same, "left").select("d.doc_id", "d.text", "s.spans")
    return keyed.mapInArrow(whole, out).unionByName(touched.mapInArrow(cut, out))
