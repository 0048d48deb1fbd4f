"""N-gram Jaccard self-join with rare-first prefix filtering.

A document's set is its distinct word shingles. Two sets link when
``den * |x and y| >= num * |x or y|``. Equal sets are one node. Shingles are ordered
by the count of their rarest word, which is no less than their own, from a counting
sketch of all words of the corpus (rare first; any order that all sets share is exact,
rarity only makes it fast). Linked sets share one of the first
``n - ceil(num * n / den) + 1`` shingles, so only those prefixes are joined, less the
shingles with a word that occurs once. A pair is dropped early by

* its sizes (length filter),
* the places of the shared shingle (positional filter),
* the differing bits of two 512-bit parity maps, which never exceed the shingles
  that only one of the sets has (suffix filter),

and verified once, on the whole sets, if it survives. 512 bits say little of a long set,
so pairs of two sets of more than 512 shingles are tried on parity maps as long as the sets
before any set is fetched. Links are followed to
components in rounds, so that no group is expanded into pairs. In a hub round every
node meets a few hubs per shared shingle, chosen by hash, and is verified against some
that survive the filters; that joins most of every component at a cost in proportion to
the postings. Then a few pairs of each two components that still share a prefix shingle
are verified and their links contracted, and at last all pairs that are
left. Only pairs that are already connected are left out, so components are exact.

Shingles with more than ``hot`` occurrences (a multiple of the sketch's mean) are split
by salt; the hubs of their salts meet like postings of their own. Later they are split
into blocks that meet pairwise.

Defined cases: null, empty and blank texts have an empty set, link with nothing and
are components of their own; a text with fewer words than a shingle is one shingle;
a null ``doc_id`` takes part and cannot name a component unless its whole component has
none (ids are numbers); rows that repeat an id are nodes of their own texts and repeated rows are kept;
an empty table gives an empty result; other columns are not read. Shingles are compared
by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import BinaryType, StructField, StructType

from quantfold.llm import bitmap, wordscan
from quantfold.llm.components import components
from quantfold.tables import Stage

SKETCH_BITS = 22
SKETCH_PARTS = 64
HOT_LEAST = 2000
HOT_TIMES_MEAN = 4
#: Sets of more shingles have a longer parity map as well.
WIDE = 512
HUB_ROUNDS, HUBS, PER_ROUND = 2, 3, 3
#: Rounds after them: the first takes a few pairs of each two components and contracts, the last one all pairs that are left.
CROSS_ROUNDS, PER_COMPONENTS = 2, 8
FEW_PAIRS = 50_000
FEW_IDS = 50_000
SIG = [f"s{i}" for i in range(8)]
#: Columns of a link: its ends and their smallest ids.
LINK = "a long, b long, la long, lb long"


@dataclass(frozen=True)
class Rule:
    width: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sets(texts: pa.Array, width: int):
    """Sorted distinct shingle hashes of each row."""
    for lo, hi in wordscan.chunks(texts):
        found, at = wordscan.windows(wordscan.scan(texts.slice(lo, hi - lo)), width)
        for r in range(hi - lo):
            yield np.unique(found[at[r] : at[r + 1]])


def _counted_sets(texts: pa.Array, width: int, counts: np.ndarray):
    """The same with the count of the rarest word of each shingle."""
    for lo, hi in wordscan.chunks(texts):
        words = wordscan.scan(texts.slice(lo, hi - lo))
        found, at = wordscan.windows(words, width)
        rarest = wordscan.least_in_windows(words, width, counts[_bucket(words.hash)])
        for r in range(hi - lo):
            tokens, place = np.unique(found[at[r] : at[r + 1]], return_index=True)
            yield tokens, rarest[at[r] : at[r + 1]][place]


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _wide(tokens: np.ndarray) -> bytes | None:
    """Parity map of a set of more than ``WIDE`` shingles, with at least a bit a shingle (a power of two)."""
    if len(tokens) <= WIDE:
        return None
    bits = 1 << (len(tokens) - 1).bit_length()
    parity = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def _wide_apart(x: bytes, y: bytes) -> int:
    """Differing bits of two such maps, the longer one folded to the shorter: at most the shingles that only one set has."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(x), len(y))
    fold = lambda m: np.bitwise_xor.reduce(m.reshape(-1, size), axis=0)
    return int(np.bitwise_count(fold(x) ^ fold(y)).sum())


def word_counts(docs: DataFrame) -> np.ndarray:
    """Word occurrences per bucket (the top bits of the hash) over all documents; a fixed-size array."""
    size = 1 << SKETCH_BITS

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            texts = b.column(0)
            for lo, hi in wordscan.chunks(texts):
                np.add.at(total, _bucket(wordscan.scan(texts.slice(lo, hi - lo)).hash), 1)
        if total.any():
            yield wordscan.pack(_capped(total), SKETCH_PARTS)

    add = lambda a, b: _capped(a.astype(np.int64) + b)
    return wordscan.merged(docs.select("text").mapInArrow(count, wordscan.PACKED), np.uint32, SKETCH_PARTS, add)


def _capped(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, 2**32 - 1).astype(np.uint32)


ROWS = "doc_id long, n int, digest binary, prefix array<bigint>, places array<int>, salts array<int>, wide binary, " + ", ".join(f"{s} bigint" for s in SIG)


def described(docs: DataFrame, rule: Rule, shared: Broadcast) -> DataFrame:
    """Per row: set size, digest of the set, rare-first prefix, their places, their salts if some are hot (0: not split) and the parity maps."""
    counts = shared.value
    hot = max(HOT_LEAST, int(HOT_TIMES_MEAN * counts.mean()) if len(counts) else 0)
    del counts

    def describe(batches):
        counts = shared.value
        for b in batches:
            n, digests, prefixes, places, salts, wide, maps = [], [], [], [], [], [], []
            for tokens, seen in _counted_sets(b.column(1), rule.width, counts):
                n.append(len(tokens))
                wide.append(_wide(tokens))
                if not len(tokens):
                    digests.append(None)
                    prefixes.append(None)
                    places.append(None)
                    salts.append(None)
                    maps.append(np.zeros(8, np.int64))
                    continue
                digest = _digest(tokens)
                digests.append(digest)
                order = np.lexsort((tokens, seen))[: rule.prefix(len(tokens))]
                # a shingle with a word that occurs once is in no other set
                place = np.flatnonzero(seen[order] > 1)
                order = order[place]
                prefixes.append(tokens[order].view(np.int64))
                places.append(place.astype(np.int32))
                splits = np.minimum(-(-seen[order].astype(np.int64) // hot), 127)
                salt = int.from_bytes(digest[:4], "big")
                salts.append(np.where(splits > 1, 1 + salt % splits, 0).astype(np.int32) if len(splits) and splits.max() > 1 else None)
                parity = np.bincount((tokens & np.uint64(511)).astype(np.int64), minlength=512) & 1
                maps.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
            sig = np.array(maps, np.int64).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(digests, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(salts, pa.list_(pa.int32())),
                    pa.array(wide, pa.binary()),
                    *[pa.array(sig[:, i]) for i in range(8)],
                ],
                names=["doc_id", "n", "digest", "prefix", "places", "salts", "wide", *SIG],
            )

    return docs.select("doc_id", "text").mapInArrow(describe, ROWS)


def _by_size(rule: Rule, nx: Column, ny: Column) -> Column:
    return rule.den * F.least(nx, ny) >= rule.num * F.greatest(nx, ny)


def _by_place(rule: Rule, nx: Column, px: Column, ny: Column, py: Column) -> Column:
    need = F.ceil(rule.num * (nx + ny) / (rule.num + rule.den))
    return F.least(px, py) + 1 + F.least(nx - 1 - px, ny - 1 - py) >= need


def _by_suffix(rule: Rule, x: str, y: str) -> Column:
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    return _apart(x, y) <= n - 2 * F.ceil(rule.num * n / (rule.num + rule.den))


def _apart(x: str, y: str) -> Column:
    bits = F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0")))
    for s in SIG[1:]:
        bits = bits + F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}")))
    return bits


#: A posting's salt, set size and place in one number (a set has fewer than 2**28 shingles).
SIZE_AT, SALT_AT, FIELD = 28, 56, (1 << 28) - 1


def _place(at: Column) -> Column:
    return at.bitwiseAND(F.lit(FIELD))


def _size(at: Column) -> Column:
    return F.shiftright(at, SIZE_AT).bitwiseAND(F.lit(FIELD))


def _postings(sets: DataFrame, rule: Rule) -> DataFrame:
    """key (the shingle, changed by its salt), node, at, for prefix shingles that another set of a fitting size may share."""
    posting = sets.select("node", "n", "salts", "places", F.posexplode("prefix").alias("i", "token"))
    posting = posting.withColumn("pos", F.get("places", F.col("i")))
    salt = F.coalesce(F.get("salts", F.col("i")), F.lit(0))
    at = F.shiftleft(salt.cast("long"), SALT_AT) + F.shiftleft(F.col("n").cast("long"), SIZE_AT) + F.col("pos")
    posting = posting.select(F.when(salt > 0, F.col("token").bitwiseXOR(F.xxhash64(salt))).otherwise(F.col("token")).alias("key"), "node", at.alias("at"))
    # of all sets of a shingle the next smaller or larger one is the likeliest to pass the length filter;
    # a split shingle may be alone under its salt and still be shared
    by_size = Window.partitionBy("key").orderBy("size")
    posting = posting.withColumn("size", _size(F.col("at"))).withColumns({"less": F.lag("size").over(by_size), "more": F.lead("size").over(by_size)})
    near = (rule.den * F.col("less") >= rule.num * F.col("size")) | (rule.den * F.col("size") >= rule.num * F.col("more"))
    return posting.filter(near | (F.col("at") >= 1 << SALT_AT)).select("key", "node", "at")


def _id_places(batch: pa.RecordBatch) -> np.ndarray:
    ids = pc.fill_null(batch.column(0).cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64)
    return (wordscan.mix(ids + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(bitmap.BITS - 1)).astype(np.int64)


def _marked(ids: DataFrame) -> Broadcast:
    return ids.sparkSession.sparkContext.broadcast(bitmap.filled(ids, _id_places))


def _keeper(shared: Broadcast, wanted: bool = True):
    """A function that keeps, of batches whose first column is the id, the rows whose id may be among the marked ones (or those whose id is not).

    It runs inside the worker that goes on with the rows."""

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(bitmap.has(shared.value, _id_places(b)) == wanted))

    return keep


def _whole_sets(docs: DataFrame, rule: Rule, wanted: DataFrame, most: int, stage: Stage, name: str) -> None:
    """Stages digest, tokens for ``wanted`` (digest, low; ``most`` rows at most), made again from the texts of the rows with such an id.

    No text is moved; the table also has sets of rows that share an id or were marked by chance, and repeats of equal rows."""

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "text")
    ids = wanted.select(F.coalesce("low", F.lit(0)).alias("doc_id")).distinct()
    if most > FEW_IDS:
        ids = stage.cut(ids)
        most = ids.count()
    if most <= FEW_IDS:
        # few ids: the other rows do not leave the scan
        texts, keep = texts.join(F.broadcast(ids), "doc_id", "left_semi"), iter
    else:
        keep = _keeper(_marked(ids))

    def remake(batches):
        for b in keep(batches):
            for lo, hi in wordscan.chunks(b.column(1)):
                sets = [t for t in _sets(b.column(1).slice(lo, hi - lo), rule.width) if len(t)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(t) for t in sets], pa.binary()), pa.array([t.tobytes() for t in sets], pa.binary())], names=["digest", "tokens"])

    stage.plain(name, texts.mapInArrow(remake, "digest binary, tokens binary"))


def _tried(chosen: DataFrame, maps: DataFrame, rule: Rule) -> DataFrame:
    """``chosen`` (a, b, da, db, la, lb) with ``alike``: false where the long parity maps of two sets rule out a link."""

    def compare(batches):
        for b in batches:
            alike = []
            for n, x, y in zip(b.column(6).to_pylist(), b.column(7), b.column(8)):
                if x.is_valid and y.is_valid:
                    alike.append(_wide_apart(x.as_py(), y.as_py()) <= n - 2 * -(-rule.num * n // (rule.num + rule.den)))
                else:
                    alike.append(True)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(alike, pa.bool_())], names=[*b.schema.names[:6], "alike"])

    pairs = _with_maps(chosen, maps.select("node", "n", "wide"))
    both = pairs.select(*chosen.columns, (F.col("x.n") + F.col("y.n")).alias("n"), F.col("x.wide").alias("wa"), F.col("y.wide").alias("wb"))
    return both.mapInArrow(compare, "a long, b long, da binary, db binary, la long, lb long, alike boolean")


def _verified(pairs: DataFrame, n_pairs: int, sets: DataFrame, rule: Rule) -> DataFrame:
    """The ``n_pairs`` pairs (a, b, da, db, la, lb) whose whole sets link, as (a, b, la, lb)."""

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(4), b.column(5)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(rule.den * both >= rule.num * (len(x) + len(y) - both))
            yield b.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("da", "db")).alias("digest")).distinct()
    if n_pairs <= FEW_PAIRS:
        # few pairs need few of the sets: only those are dealt out
        sets = sets.join(F.broadcast(ends), "digest", "left_semi")
    left = pairs.join(sets.withColumnsRenamed({"digest": "da", "tokens": "ta"}), "da")
    both = left.join(sets.withColumnsRenamed({"digest": "db", "tokens": "tb"}), "db")
    return both.select("a", "b", "la", "lb", "ta", "tb").mapInArrow(check, LINK).distinct()


def _ends() -> list[Column]:
    """Digest and smallest id of both ends of a pair, from their maps."""
    return [F.col(f"{side}.{c}").alias(f"{c[0]}{end}") for c in ("digest", "low") for side, end in (("x", "a"), ("y", "b"))]


def _with_maps(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    return pairs.join(maps.alias("x"), F.col("a") == F.col("x.node")).join(maps.alias("y"), F.col("b") == F.col("y.node"))


def _placed(shared: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return shared.withColumn("comp", F.col("node"))
    return shared.join(comp.select("node", "comp"), "node", "left").select("key", "node", "at", F.coalesce("comp", "node").alias("comp"))


def _met(placed: DataFrame, rule: Rule, seed: int) -> DataFrame:
    """Postings (key, node, at, comp) beside a few hubs of their key that are in other components and pass length and place."""
    row, group = F.struct("node", "at", "comp"), Window.partitionBy("key")
    hub = lambda i: F.min_by(row, F.xxhash64("node", "key", F.lit(seed * HUBS + i))).over(group)
    # dealt by key first: what the windows order by and take is formed after that, not moved
    met = placed.repartition("key").withColumns({"lo": F.min("comp").over(group), "hi": F.max("comp").over(group), "hubs": F.array(*[hub(i) for i in range(HUBS)])}).filter("lo <> hi")
    met = met.select("node", "at", "comp", F.explode(F.array_distinct("hubs")).alias("h"))
    mine, other = F.col("at"), F.col("h.at")
    return met.filter(
        (F.col("comp") != F.col("h.comp")) & _by_size(rule, _size(mine), _size(other)) & _by_place(rule, _size(mine), _place(mine), _size(other), _place(other))
    ).select(F.greatest("node", "h.node").alias("a"), F.least("node", "h.node").alias("b"))


def _hub_pairs(placed: DataFrame, maps: DataFrame, rule: Rule, seed: int) -> DataFrame:
    """a, b, da, db, la, lb: nodes and hubs of other components that pass the filters; the hubs of a split shingle's salts meet in the same way."""
    hub = lambda i: F.min_by(F.struct("node", "at", "comp"), F.xxhash64("node", "key", F.lit(seed * HUBS + i)))
    split = placed.filter(F.col("at") >= 1 << SALT_AT).groupBy("key").agg(F.array_distinct(F.array(*[hub(i) for i in range(HUBS)])).alias("hubs"))
    hubs = split.select("key", F.explode("hubs").alias("h")).select(_token(F.col("key"), F.col("h.at")).alias("key"), "h.node", "h.at", "h.comp")
    pairs = _met(placed, rule, seed).unionByName(_met(hubs, rule, seed)).distinct()
    return _with_maps(pairs, maps).filter(_by_suffix(rule, "x", "y")).select("a", "b", *_ends())


def _token(key: Column, at: Column) -> Column:
    """The shingle of a key."""
    salt = F.shiftright(at, SALT_AT).cast("int")
    return F.when(salt > 0, key.bitwiseXOR(F.xxhash64(salt))).otherwise(key)


def _cross_pairs(placed: DataFrame, maps: DataFrame, rule: Rule) -> DataFrame:
    """a, b, da, db, la, lb and ca, cb (their components): all pairs of different components that share a prefix shingle and pass the filters."""
    placed = placed.select(_token(F.col("key"), F.col("at")).alias("token"), "node", "at", "comp")
    groups = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).filter("lo <> hi")
    blocks = F.ceil(F.col("k") / HOT_LEAST).cast("int")
    mixed = placed.join(groups.select("token", "k"), "token").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    mixed = mixed.select("token", "node", "at", "comp", "block", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"))
    mixed = mixed.withColumn("n", _size(F.col("at"))).join(maps.select("node", *SIG), "node")
    x, y = mixed.alias("x"), mixed.alias("y")
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.b0") == F.col("y.b0")) & (F.col("x.b1") == F.col("y.b1"))
    # a pair of one block would meet in every pair of blocks with it
    once = (F.col("x.block") != F.col("y.block")) | (F.col("x.b0") == F.col("x.b1"))
    different = (F.col("x.node") > F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
    nx, ny = F.col("x.n"), F.col("y.n")
    fits = _by_size(rule, nx, ny) & _by_place(rule, nx, _place(F.col("x.at")), ny, _place(F.col("y.at"))) & _by_suffix(rule, "x", "y")
    comps = [F.least("x.comp", "y.comp").alias("ca"), F.greatest("x.comp", "y.comp").alias("cb")]
    pairs = x.join(y, meet & once & different & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), *comps).distinct()
    return _with_maps(pairs, maps.select("node", "digest", "low")).select("a", "b", *_ends(), "ca", "cb")


def _still_apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those of such pairs whose ends are in different components by now."""
    of = lambda end: comp.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}"))
    now = pairs.drop("ca", "cb").join(of("a"), "a", "left").join(of("b"), "b", "left")
    ca, cb = F.coalesce("ca", "a"), F.coalesce("cb", "b")
    return now.withColumns({"ca": F.least(ca, cb), "cb": F.greatest(ca, cb)}).filter("ca <> cb")


def near_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of its component, itself for empty sets), n_copies (rows with the same set)."""
    return _labelled(*_grouped(docs, rule))


def _grouped(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, one node per different set, and node, comp, comp_low (the smallest id of the component) of each node that has links."""
    spark = docs.sparkSession
    stage = Stage(spark, "near")
    shared = spark.sparkContext.broadcast(word_counts(docs))
    rows = stage.plain("rows", described(docs, rule, shared).withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()
    reps = rows.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"), F.count("*").alias("n_copies"))
    reps = stage.plain("reps", reps)
    sets_of = rows.drop("doc_id", "digest").withColumnRenamed("row", "node").join(reps.select("node", "digest", "low"), "node")
    shared = stage.plain("shared", _postings(sets_of, rule))
    maps = stage.plain("maps", sets_of.select("node", "n", "digest", "low", "wide", *SIG).join(shared.select("node").distinct(), "node", "left_semi"))

    # prefixes and maps are in the tables above; the rest of the rows is short
    rows = stage.plain("named", rows.select("doc_id", "n", "digest"))
    stage.drop("rows")

    # names of the staged tables of all rounds, each kind read by one scan
    tried, known, linked = [], [], []
    comp, found_links = None, False
    for k in range(HUB_ROUNDS + CROSS_ROUNDS):
        if k < HUB_ROUNDS:
            found = _hub_pairs(_placed(shared, comp), maps, rule, k)
        elif k == HUB_ROUNDS:
            found = _cross_pairs(_placed(shared, comp), maps, rule)
        else:
            # components only grow, so the pairs that are left are among those of the round before
            found = _still_apart(found, comp)
        if tried:
            found = found.join(stage.together(tried).select("a", "b"), ["a", "b"], "left_anti")
        few = None
        if k < HUB_ROUNDS:
            few = Window.partitionBy("a").orderBy(F.xxhash64("a", "b", F.lit(k))), PER_ROUND
        else:
            found = stage.plain(f"pairs{k}", found)
            n_found = found.count()
            if not n_found:
                break
            if k < HUB_ROUNDS + CROSS_ROUNDS - 1 and found_links:
                # a few pairs of each two components; what they leave is looked at again after contraction
                few = Window.partitionBy("ca", "cb").orderBy(F.xxhash64("a", "b")), PER_COMPONENTS
        chosen = found.withColumn("k", F.row_number().over(few[0])).filter(F.col("k") <= few[1]) if few else found
        tried.append(f"chosen{k}")
        chosen = stage.plain(tried[-1], _tried(chosen.select("a", "b", "da", "db", "la", "lb"), maps, rule))
        n_chosen = chosen.count() if few else n_found
        if not n_chosen:
            continue
        chosen = chosen.filter("alike").drop("alike")
        ends = F.explode(F.array(*[F.struct(F.col(f"d{x}").alias("digest"), F.col(f"l{x}").alias("low")) for x in "ab"]))
        needed = chosen.select(ends.alias("end")).select("end.*").distinct()
        if known:
            needed = needed.join(stage.together(known).select("digest").distinct(), "digest", "left_anti")
        known.append(f"sets{k}")
        _whole_sets(docs, rule, needed, 2 * n_chosen, stage, known[-1])
        verified = stage.plain(f"links{k}", _verified(chosen, n_chosen, stage.together(known), rule))
        found_links = not verified.isEmpty()
        if found_links:
            linked.append(f"links{k}")
            comp = _components(stage.together(linked), stage)
        if k >= HUB_ROUNDS and n_chosen == n_found:
            break
    for name in (*known, *tried):
        stage.drop(name)
    none = reps.filter(F.lit(False)).select("node", F.col("node").alias("comp"), F.col("low").alias("comp_low"))
    return rows, reps, none if comp is None else comp


def _components(links: DataFrame, stage: Stage) -> DataFrame:
    """Nodes are ordered by their smallest id, so that a component is named by its smallest id at once."""
    end = lambda low, node: F.struct(F.col(low).isNull().alias("free"), F.col(low).alias("low"), F.col(node).alias("node"))
    found = components(links.select(end("la", "a").alias("a"), end("lb", "b").alias("b")), stage)
    return found.select("node.node", F.col("comp.node").alias("comp"), F.col("comp.low").alias("comp_low"))


def _labelled(rows: DataFrame, reps: DataFrame, comp: DataFrame) -> DataFrame:
    named = reps.join(comp, "node", "left").select("digest", F.coalesce("comp_low", "low").alias("low"), "n_copies")
    return rows.select("doc_id", "n", "digest").join(named, "digest", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")
    )


def one_per_group(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Of each component the row with the smallest id, then digest of its set, then columns in order; documents without words or without an id are kept.

    Rows whose id only stands for sets without copies pass as they are; the others are told apart by id and digest."""
    rows, reps, comp = _grouped(docs, rule)
    stage = Stage(docs.sparkSession, "single")
    nodes = reps.join(comp, "node", "left")
    first = nodes.filter("low IS NOT NULL").groupBy(F.coalesce("comp", "node").alias("comp")).agg(F.min(F.struct("low", "digest")).alias("first"))
    copied = nodes.filter("n_copies > 1 OR comp IS NOT NULL").select("digest")
    held = rows.filter("n > 0 AND doc_id IS NOT NULL")
    unsure = held.join(copied, "digest", "left_semi").select("doc_id").unionByName(held.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    unsure = stage.plain("unsure", unsure.distinct())

    # columns go through under plain names, since the names of a table may be anything
    plain = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)]
    renamed = docs.toDF(*plain)
    names = ["doc_id", *[c for c in plain if c != "doc_id"]]
    texts = renamed.select(*names)
    no_words = F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\f\r", "")) == 0
    free = texts.filter(F.col("doc_id").isNull() | no_words)
    worded = texts.filter(F.col("doc_id").isNotNull() & ~no_words)
    marked = _marked(unsure)
    alone = worded.mapInArrow(_keeper(marked, wanted=False), worded.schema)
    at, keep = names.index("text"), _keeper(marked)

    def add(batches):
        for b in keep(batches):
            digests = [_digest(tokens) for tokens in _sets(b.column(at), rule.width)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.binary())], names=[*b.schema.names, "near_digest"])

    told = worded.mapInArrow(add, StructType([*texts.schema.fields, StructField("near_digest", BinaryType())]))
    kept = first.select(F.col("first.low").alias("near_low"), F.col("first.digest").alias("near_of"))
    one = told.join(kept, (F.col("doc_id").cast("long") == F.col("near_low")) & (F.col("near_digest") == F.col("near_of")), "left_semi")
    ordered = Window.partitionBy("doc_id", "near_digest").orderBy(*[F.col(c) for c, t in renamed.dtypes if "map<" not in t and t != "variant"])
    one = one.withColumn("near_place", F.row_number().over(ordered)).filter("near_place = 1")
    return alone.select(*plain).unionByName(one.select(*plain)).unionByName(free.select(*plain)).toDF(*docs.columns)
