import random
import re
from collections import Counter, defaultdict

import pytest
from quantfold.llm import source_divergence as sd
from helpers_llm import LOWER, documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(texts, langs, sources, least, top=50):
    docs, uses, groups = defaultdict(Counter), defaultdict(Counter), set()
    for t, g, s in zip(texts, langs, sources):
        g, s = g or "", s or ""
        groups.add((g, s))
        found = TERM.findall((t or "").translate(LOWER))
        docs[g].update(set(found))
        uses[g, s].update(found)
    out = set()
    for g in {g for g, _ in groups}:
        kept = sorted(w for w, n in docs[g].items() if n >= least)
        own = [s for h, s in groups if h == g]
        every = Counter()
        for s in own:
            every.update(uses[g, s])

        def scores(counts):
            n = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 5) // (n + 5 * len(kept)) for w in kept}

        p = {s: scores(uses[g, s]) for s in own}
        q = scores(every)
        for s in own:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in own if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if uses[g, s][w] and p[s][w] > q[w]]
            for part, rows in (("pair", pairs), ("term", terms)):
                for k, (v, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode())), 1):
                    if part == "pair" or k <= top:
                        out.add((g, s, part, item, v, k))
    return out


def run(spark, texts, langs, sources, **kw):
    rows = sd.source_divergence(documents(spark, texts, langs=langs, sources=sources), **kw).collect()
    return {(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in rows}, len(rows)


def corpus(seed, n=120):
    rng = random.Random(seed)
    pool = ["a", "ab", "abc", "abcd", "abcde", "Abcdefgh", "abcdefghi", "straße", "straßenbahnhaltestelle", "x" * 70, "x" * 71, "éé", "日本語日本語日本語"] + [f"rare{'q' * k}" for k in range(20)]
    texts = [re.sub("$", rng.choice(["", "!", "1"]), "-".join(rng.choices(pool, k=rng.randrange(25)))) for _ in range(n)]
    return texts, rng.choices(["en", "de", None], k=n), rng.choices(["s1", "s2", "s3", None, "é"], k=n)


@pytest.mark.parametrize("least", [1, 5, 30])
def test_against_brute_force(spark, least):
    texts, langs, sources = corpus(least)
    got, n = run(spark, texts, langs, sources, least_docs=least)
    assert got == brute(texts, langs, sources, least) and n == len(got)


def test_tiles_blocks_and_chunks_agree(spark, monkeypatch):
    monkeypatch.setattr(sd, "TILE", 2)
    monkeypatch.setattr(sd, "BLOCK_CELLS", 7)
    monkeypatch.setattr(sd, "CHUNK_BYTES", 200)
    texts, langs, sources = corpus(7)
    assert run(spark, texts, langs, sources, least_docs=3)[0] == brute(texts, langs, sources, 3)


def test_prefixes_below_the_threshold_are_not_extended(spark, monkeypatch):
    seen = []
    level = sd._level
    monkeypatch.setattr(sd, "_level", lambda docs, kept, parent, width: seen.append(width) or level(docs, kept, parent, width))
    texts = ["common common"] * 6 + [f"word{'abcdefgh'[i]}longertermthanothers" for i in range(6)]
    counts = {r.term: r.n for r in sd.term_counts(documents(spark, texts), 6).collect()}
    # "word" has six documents, none of its continuations does: no pass goes beyond eight bytes
    assert counts == {"common": 12} and seen == [4, 8]


def test_edges(spark):
    assert run(spark, [], [], [])[1] == 0
    # no kept terms: pairs of value 0
    assert run(spark, [None, "", "1 2", "a"], [None, None, "en", "en"], [None, "s", "s", "t"])[0] == {
        ("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1), ("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)
    }
    # repeated rows are documents of their own; one very long text
    long = "ab " * 200_000
    got, _ = run(spark, [long, "Cd"] + ["Cd"] * 3, ["en"] * 5, ["s"] + ["t"] * 4, least_docs=2)
    assert got == brute([long, "Cd"] + ["Cd"] * 3, ["en"] * 5, ["s"] + ["t"] * 4, 2)
