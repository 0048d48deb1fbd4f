import hashlib
import random
import re

from quantfold.llm.decontaminate import clean_documents, decontaminate
from helpers_llm import LOWER, documents

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return TOKEN.findall((t or "").translate(LOWER))


def brute(texts, items, width=10, containment=1.0):
    out = []
    for t in texts:
        w, hit, found = tokens(t), set(), set()
        for name, x in items:
            own = tokens(x)
            if name is None or not own:
                continue
            for i in range(max(1, len(own) - width + 1)):
                win = own[i : i + width]
                for k in range(len(w) - len(win) + 1):
                    same = sum(a == b for a, b in zip(w[k : k + len(win)], win))
                    if same >= max(1, containment * len(win) - 1e-9):
                        hit |= set(range(k, k + len(win)))
                        found.add(str(name))
        out.append((len(w), len(hit), sorted(found)))
    return out


def run(spark, texts, items, **kw):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate(documents(spark, texts), bench, **kw).collect()
    return [(r.n_words, r.n_hit, r["items"]) for r in sorted(rows, key=lambda r: r.doc_id)]


def case(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 3, 10, 14, 25])))) for i in range(12)]
    texts = []
    for _ in range(25):
        t = rng.choices(pool, k=rng.randrange(40))
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(own))
            t[rng.randrange(len(t) + 1) : 0] = [x.upper() + "," for x in own[a : a + rng.randrange(1, 20)]]
        texts.append("  ".join(t))
    return texts, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts, items = case(seed)
        assert run(spark, texts, items) == brute(texts, items)


def test_partial_containment(spark):
    texts, items = case(3)
    assert run(spark, texts, items, width=6, containment=0.7) == brute(texts, items, 6, 0.7)


def test_blocks_agree(spark):
    texts, items = case(4)
    assert run(spark, texts, items, block_bytes=100) == brute(texts, items)


def test_edges(spark):
    long = " ".join(f"a{i}" for i in range(30_000))
    items = [(1, "a29990 a29991 a29992"), (1, "zz"), (2, None), (3, " .,"), (None, "one"), (10, "é ü")]
    texts = [None, "", "one", "É Ü é-ü", long, "zz"]
    assert run(spark, texts, items) == [(0, 0, []), (0, 0, []), (1, 0, []), (4, 2, ["10"]), (30000, 3, ["1"]), (1, 1, ["1"])]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, ["a b"], []) == [(2, 0, [])]


def test_clean_documents(spark):
    docs = documents(spark, ["it has the item", "clean", None], ids=[4, 4, None])
    kept = clean_documents(docs, spark.createDataFrame([(1, "the item")], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == ["", "clean"]


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
