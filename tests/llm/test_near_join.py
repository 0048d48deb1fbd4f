import random

from quantfold.llm import near_join
from quantfold.llm.near_join import Rule, near_groups, one_per_group
from helpers_llm import documents, groups, shingles


def vary(rng, base, changes):
    w = base.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed, n_groups=6, size=12):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n_groups):
        base = " ".join(rng.choices(pool, k=rng.choice([4, 40, 120])))
        for _ in range(size):
            texts.append(vary(rng, base, rng.randrange(4)))
            if rng.random() < 0.3:
                base = texts[-1]
    return texts + texts[:5]


def check(spark, texts, rule):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(documents(spark, texts), rule).collect()}
    sets = {i: shingles(t, rule.width) for i, t in enumerate(texts)}
    want = groups(sets, rule.num, rule.den)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_against_all_pairs(spark):
    check(spark, corpus(1), Rule(3, 90, 100))
    check(spark, corpus(2), Rule(5, 80, 100))


def test_split_groups_are_exact(spark, monkeypatch):
    monkeypatch.setattr(near_join, "HOT_LEAST", 3)
    monkeypatch.setattr(near_join, "HOT_TIMES_MEAN", 0)
    check(spark, corpus(3), Rule(3, 80, 100))


def test_edges(spark):
    long = " ".join(f"a{i}" for i in range(30_000))
    texts = [None, "", "  \n ", "one", "ONE ", "one two", long, long + " b", "É", "é"]
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(documents(spark, texts), Rule(3, 90, 100)).collect()}
    assert rows == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (29998, 6), 7: (29999, 6), 8: (1, 8), 9: (1, 9)}


def test_repeated_and_null_ids(spark):
    texts = ["a b c d e f", "a b c d e f", "a b c d e f", "q r s t u v", "x y z x y z"]
    out = near_groups(documents(spark, texts, ids=[7, 7, None, 7, None]), Rule()).collect()
    assert sorted((r.doc_id or -1, r.component_id if r.component_id is not None else -1) for r in out) == [(-1, -1), (-1, 7), (7, 7), (7, 7), (7, 7)]


def test_empty_table(spark):
    assert near_groups(documents(spark, []), Rule()).count() == 0
    assert one_per_group(documents(spark, []), Rule()).count() == 0


def test_one_per_group_keeps_columns(spark):
    texts = ["a b c d e f g", "a b c d e f g", "h i j k l m n", None, " "]
    docs = documents(spark, texts, ids=[5, 3, 9, 1, 1])
    kept = one_per_group(docs, Rule())
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 3, 9]


def test_one_row_of_each_component_where_ids_repeat(spark):
    rng = random.Random(12)
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    copy = own[0] + " end"
    rows = [(3, own[0]), (5, copy), (5, own[1]), (5, own[2]), (5, own[1].upper()), (7, own[2] + " x"), (None, own[3]), (8, "")]
    want = [(3, own[0]), (5, own[1].upper()), (5, own[2]), (None, own[3]), (8, "")]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]).coalesce(2)
    out = one_per_group(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_pairs_left_for_the_end_grow_with_the_group(spark, monkeypatch):
    """A group of near copies under split shingles is one component before all pairs are taken."""
    monkeypatch.setattr(near_join, "HOT_LEAST", 60)
    monkeypatch.setattr(near_join, "HOT_TIMES_MEAN", 0)
    made, cross = [], near_join._cross_pairs

    def counted(*args):
        out = cross(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_join, "_cross_pairs", counted)
    rng = random.Random(21)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(150))
    left = {}
    for n in (300, 600):
        made.clear()
        rows = near_groups(documents(spark, [vary(rng, base, 1 + k % 2) for k in range(n)]), Rule(3, 90, 100)).collect()
        assert {r.component_id for r in rows} == {0}
        left[n] = sum(made)
    # in proportion to the group, not to its 44,850 and 179,700 pairs
    assert left[300] <= 6 * 300 and left[600] <= 6 * 600


def test_columns_of_any_name_pass_through(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "x y z u v w"]).withColumnRenamed("node", "a.b").withColumnRenamed("kept", "near_digest").withColumnRenamed("u", "near_low")
    kept = one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_jobs_do_not_pile_up_over_the_rounds(spark):
    """Each round reads the tables of all rounds by one scan and decides on counts that are known; one Spark job more is memory of the driver."""
    rng = random.Random(8)
    bases = [" ".join(f"w{rng.randrange(4000)}" for _ in range(80)) for _ in range(30)]
    texts = [vary(rng, bases[i % 30], rng.randrange(4)) for i in range(300)]
    docs = documents(spark, texts).coalesce(2)
    spark.sparkContext.setJobGroup("near-copies", "near copies")
    try:
        kept = {r.doc_id for r in one_per_group(docs, Rule(5, 80, 100)).select("doc_id").collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near-copies"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert kept == set(groups({i: shingles(t, 5) for i, t in enumerate(texts)}, 80, 100).values())
    assert 0 < jobs <= 155, jobs


def test_sets_that_long_maps_tell_apart_are_not_fetched(spark, monkeypatch):
    """Long texts that share a common opening fill a map of 512 bits and passed as pairs; now only sets that may link are made again."""
    rng = random.Random(5)
    opening = " ".join(f"o{i}" for i in range(400))
    texts = [opening + " " + " ".join(f"t{k}x{i}" if i % 9 else f"c{rng.randrange(40)}" for i in range(1600)) for k in range(12)]
    texts += [t + " end" for t in texts[:2]]
    sizes, whole = [], near_join._whole_sets

    def counted(docs, rule, wanted, *args):
        sizes.append(wanted.count())
        return whole(docs, rule, wanted, *args)

    monkeypatch.setattr(near_join, "_whole_sets", counted)
    got = {r.doc_id: r.component_id for r in near_groups(documents(spark, texts), Rule(5, 80, 100)).collect()}
    assert got == groups({i: shingles(t, 5) for i, t in enumerate(texts)}, 80, 100) and len(set(got.values())) == 12
    assert sum(sizes) == 4, sizes


def test_long_maps_never_count_too_much():
    import numpy as np

    rng = np.random.default_rng(3)
    tokens = lambda n: np.unique(rng.integers(0, 2**64, n, np.uint64))
    for n, more, other in ((520, 0, 0), (1400, 30, 10), (5000, 4, 900), (600, 3000, 50)):
        both = tokens(n)
        x, y = np.union1d(both, tokens(more)), np.union1d(both, tokens(other))
        assert near_join._wide_apart(near_join._wide(x), near_join._wide(y)) <= len(np.setxor1d(x, y))
    assert near_join._wide(tokens(512)) is None


def test_rows_with_prefixes_and_whole_sets_do_not_stay_on_disk(spark, monkeypatch):
    from pathlib import Path

    stages = []
    monkeypatch.setattr(near_join, "Stage", lambda *args: stages.append(near_join_stage(*args)) or stages[-1])
    texts = [f"a b c d e f g h i j k l m n o p q r s t {'u' * (k % 2)}" for k in range(20)]
    rows = near_groups(documents(spark, texts), Rule(3, 80, 100)).collect()
    assert {r.component_id for r in rows} == {0}
    left = {p.name for p in Path(stages[0].root.removeprefix("file:")).iterdir()}
    assert "named" in left and not [name for name in left if name == "rows" or name.startswith(("sets", "chosen"))], left


near_join_stage = near_join.Stage
