"""Small document tables and plain-Python counterparts."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, token int, kept string, u double, spans string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, ids=None, langs=None, sources=None):
    """Rows with extra columns whose names the operators use inside."""
    rows = [
        (ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", None if t is None else len(t), "x", 1, "y", 0.5, "z")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def groups(sets, num, den):
    """Smallest id of the component of each id, by all pairs."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                one, two = find(a), find(b)
                parent[max(one, two)] = min(one, two)
    return {i: find(i) for i in ids}


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
