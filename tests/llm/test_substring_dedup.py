import random
from collections import defaultdict

import pytest
from quantfold.llm import substring_dedup as sd
from helpers_llm import documents, words


def brute(texts, ids, width):
    first = {}
    for t, i in zip(texts, ids):
        w = words(t)
        for k in range(len(w) - width + 1):
            if i is not None:
                win = tuple(w[k : k + width])
                first[win] = min(first.get(win, i), i)
    out = []
    for t, i in zip(texts, ids):
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def run(spark, texts, ids, width):
    rows = sd.remove_repeats(documents(spark, texts, ids=ids), width).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str)


def corpus(seed, n=60, width=12):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)] + ["a", "b"]
    passages = [rng.choices(pool, k=rng.randrange(width - 3, 4 * width)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = rng.choices(pool, k=rng.randrange(5 * width))
        for _ in range(rng.randrange(4)):
            own = list(rng.choice(passages))
            if rng.random() < 0.3:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(t) + 1)
            t[at:at] = own
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(t))
    return texts + texts[:3] + ["a " * 300, "b a " * 200, "a " * 250], rng.sample(range(n), n) + [3, 500, 501, 502, 503, 504]


@pytest.mark.parametrize("many,window", [(200, 64), (0, 64), (1, 3)])
def test_against_brute_force(spark, monkeypatch, many, window):
    monkeypatch.setattr(sd, "MANY_BODIES", many)
    monkeypatch.setattr(sd, "SPAN_WINDOWS", window)
    monkeypatch.setattr(sd, "SHARD_WORDS", 300)
    texts, ids = corpus(window + many)
    assert run(spark, texts, ids, 12) == brute(texts, ids, 12)


def test_edges(spark):
    base = " ".join(f"v{i}" for i in range(60))
    texts = [None, "", " \n", "x " * 49, base, base, base, base.upper(), base + " é", base]
    ids = [1, 2, 3, 4, 9, 9, None, 5, 12, 10]
    got = run(spark, texts, ids, 50)
    assert got == brute(texts, ids, 50)
    # equal ids do not remove words of each other, a null id takes no part, words are compared as they are
    removed = defaultdict(list)
    for i, _, n, _ in got:
        removed[i].append(n)
    assert removed == {1: [0], 2: [0], 3: [0], 4: [0], 9: [0, 0], None: [0], 5: [0], 12: [60], 10: [60]}
    assert run(spark, [], [], 50) == []


def test_a_long_text_and_its_copy(spark):
    rng = random.Random(5)
    long = " ".join(f"t{rng.randrange(5000)}" for _ in range(120_000))
    assert [r[:3] for r in run(spark, [long, "new " + long], [8, 9], 50)] == [(8, 120_000, 0), (9, 120_001, 120_000)]


def test_automaton_knows_the_first_owner_of_each_window():
    rng = random.Random(2)
    for _ in range(20):
        held = [([rng.randrange(3) for _ in range(rng.randrange(4, 20))], owner) for owner in rng.sample(range(100), 6)]
        automaton = sd.Automaton()
        for w, owner in held:
            automaton.add(w, owner)
        automaton.close()
        for w in [[rng.randrange(3) for _ in range(25)], *[h[0] for h in held]]:
            want = [min([o for v, o in held if any(v[j : j + 4] == w[i : i + 4] for j in range(len(v) - 3))], default=None) for i in range(len(w) - 3)]
            assert automaton.first_owners(w, 4) == want


def test_windows_at_the_borders_of_a_common_passage_stay_few(spark, monkeypatch):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(80)]
    texts = [" ".join([f"a{k}_{i}" for i in range(60)] + passage[: 80 - k % 2] + [f"z{k}_{i}" for i in range(60)]) for k in range(150)]
    ids = rng.sample(range(1000), 150)
    made = []
    windows = sd._windows

    def counted(*args):
        rows = windows(*args)
        made.append(rows.count())
        return rows

    monkeypatch.setattr(sd, "_windows", counted)
    monkeypatch.setattr(sd, "MANY_BODIES", 20)
    assert run(spark, texts, ids, 50) == brute(texts, ids, 50)
    # a window for each different one and task, not those of each document
    assert made and max(made) <= 31 * 8
