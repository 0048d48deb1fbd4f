"""Secret scans, token counts, the quality classifier and connected components."""

import random
import re
import string
import zlib

import pytest

from quantfold.llm import quality_model, secret_scan, token_counts
from quantfold.llm.components import components
from quantfold.tables import Stage
from helpers_llm import documents

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def brute(text):
    out = []
    for k, (pattern, group, least) in enumerate(BASE.values()):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(out)]


def spans(spark, texts):
    rows = secret_scan.scan_secrets(documents(spark, texts)).collect()
    return [[(f"{s.kind}:{s.start}:{s.end}") for s in r.spans] for r in sorted(rows, key=lambda r: r.doc_id)]


def test_base_spans(spark):
    rng = random.Random(2)
    bits = ["token", "Secret", "PASSWORD", "api_key", "apikey", "=", ": ", ' "', "'", "abcdef", "0123456789abcdef", "AKIA", "QWERTYUIOP123456", "é", "😀", "\n", " ", "ſecret", "K", "toKen=xyz"]
    texts = ["".join(rng.choices(bits, k=25)) for _ in range(400)] + [None, "", "x " * 100_000 + "token=abcdefgh", "secret: token: abcdef"]
    for got, text in zip(spans(spark, texts), texts):
        assert [s for s in got if not s.startswith("novel")] == brute(text)


def test_novel_spans(spark):
    rng = random.Random(4)
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=32))
    code = "def load(session_handler_v2):\n    handler = session_handler_v2\n    return handler\n"
    texts = [
        f"{code} the api key is {key} here", f"{code} my secret {key} and again {key}", f"{code} the token session_handler_v2 is read", f"the report {key} is long",
        "secret_store your_password_example_1234567890 x",
    ]
    got = spans(spark, texts)
    at = texts[0].index(key)
    assert got[0] == [f"novel:{at}:{at + 32}"]
    assert [s.split(":")[0] for s in got[1]] == ["novel"]
    assert got[2] == got[3] == got[4] == []


def test_long_texts_of_tokens_take_linear_time():
    import time

    for line in ("token=abcdef123456789\n", "token.", "secret "):
        text = line * (1_000_000 // len(line))
        start = time.perf_counter()
        secret_scan.spans_of(text)
        assert time.perf_counter() - start < 5, line


def test_planted_keys_are_found_and_planted_names_are_not(spark):
    rng = random.Random(31)
    words = ["session", "provider", "authentication", "factory", "service", "cluster", "refresh", "expiry", "seconds", "manager", "security", "internal", "oauth", "example", "production", "handler"]
    prose = " ".join(words) + ". " + " ".join(w.capitalize() for w in words)

    def name():
        own = rng.choices(words, k=rng.randrange(3, 6))
        return rng.choice(["".join(w.capitalize() for w in own) + "V2", "_".join(own) + "_v2", "-".join(own) + "-1", "com." + ".".join(own), "".join(w.capitalize() for w in own)])

    alphabets = [string.ascii_letters + string.digits, "0123456789ABCDEF", string.ascii_uppercase, string.digits, string.ascii_letters]
    keys = ["".join(rng.choices(alphabets[k % 5], k=rng.randrange(24, 64))) for k in range(200)]
    names = [name() for _ in range(200)]
    before = ["Authorization: Bearer ", "the secret key is ", "our token was "]
    texts = [f"{prose} {rng.choice(before)}{x} and so on" for x in keys + names]
    got = spans(spark, texts)
    # long runs of digits are hex spans already
    found = [sum(any(s.startswith(kinds) for s in g) for g in part) for kinds, part in ((("novel", "hex"), got[:200]), ("novel", got[200:]))]
    assert found[0] >= 190 and found[1] <= 6, found


def test_novel_spans_of_every_candidate():
    rng = random.Random(9)
    draw = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    base64 = string.ascii_letters + string.digits + "+/"
    code = "def load(session_handler_v2):\n    handler = session_handler_v2\n    return handler\n"
    for _ in range(40):
        jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9." + draw(base64[:62], 60) + "." + draw(base64[:62], 43)
        key = draw(base64[:62], 32)
        for before, secret in [
            ("the api key is ", draw("0123456789ABCDEF", 64)), ("the api key is ", draw("0123456789ABCDEF", 128)), ("private key ", draw(base64, 400)),
            ("Authorization: Bearer ", jwt), ("token for AuthenticationServiceProvider ", key), ("token of service_provider_v2_handler ", key), ("secret=abcdef12 or else ", key),
        ]:
            text = f"{code} {before}{secret} here"
            at = text.index(secret)
            assert ("novel", at, at + len(secret)) in [x[:3] for x in secret_scan.spans_of(text)], text
            assert secret not in secret_scan.redacted(text, secret_scan.spans_of(text))
    # what a base span leaves of a candidate, and text that is no key
    rest = draw(string.ascii_uppercase + string.digits, 40)
    text = f"{code} a bearer {'0123456789abcdef' * 2}.{rest} here"
    assert [text[x[1] : x[2]] for x in secret_scan.spans_of(text)] == ["0123456789abcdef" * 2, rest]
    for text in (f"{code} the token session_handler_v2.session_handler_v2.session_handler_v2.session_handler_v2 x", "a token of www.a1.example.com or so", "password " + "example_placeholder_1234567890_" * 5):
        assert secret_scan.spans_of(text) == []


def test_redact(spark):
    docs = documents(spark, ["a token=abcdefgh z", None, "é password: deadbeefdeadbeefdeadbeef.", "clean"])
    out = secret_scan.redact(docs)
    assert out.schema == docs.schema
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i].text for i in range(4)] == ["a token=[secret] z", None, "é password: [secret]", "clean"]
    assert rows[0].n_chars == 18 and rows[1].n_chars is None and rows[3].n_chars == 5
    assert secret_scan.redact(documents(spark, [])).count() == 0


def tokenizer(vocabulary):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("[\\x20\\x09-\\x0D]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)])
    return made


def same_counts(spark, texts, vocabulary):
    made = tokenizer(vocabulary)
    for r in token_counts.count_tokens(documents(spark, texts), vocabulary).collect():
        ids = made.encode(texts[r.doc_id] or "").ids
        assert (r.n_tokens, r.n_unknown) == (len(ids), sum(i == 0 for i in ids)), texts[r.doc_id]


def test_counts_match_the_library(spark):
    rng = random.Random(6)
    letters = "abcdé"
    vocabulary = {"".join(rng.choices(letters + "▁", k=1) + rng.choices(letters, k=rng.randrange(4))): -float(rng.randrange(1, 5)) for _ in range(60)}
    vocabulary = [(p, s) for p, s in vocabulary.items() if p not in ("e", "x")]
    texts = [" ".join("".join(rng.choices(letters + "x😀", k=rng.randrange(1, 12))) for _ in range(rng.randrange(6))) for _ in range(300)]
    same_counts(spark, texts + [None, "", " \n", "a" * 50_000, "x\x0by"], vocabulary)


def test_counts_of_the_public_vocabulary(spark, sf_dir):
    vocabulary = token_counts.zipf_vocabulary()
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    same_counts(spark, texts, vocabulary)
    assert token_counts.count_tokens(documents(spark, []), vocabulary).count() == 0


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choices(["the", "of", "stone", "river", "house", "green", "walks", "slowly"], k=rng.randrange(5, 60))) for _ in range(600)]
    bad = [" ".join(w + rng.choice(["$$$", "###", "!!"]) for w in g.split()) for g in good[:300]]
    texts = good + bad + [None, "", "a " * 50_000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 600), 0) for i in range(900)] + [(0, None, 0), (None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_model.score_quality(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    out = [r for i, r in rows.items() if r.held_out and i < 900]
    assert sum((r.score >= 0.3) == (r.doc_id < 600) for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in rows.values()) and len(rows) == 903


def test_classifier_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_model.score_quality(documents(spark, ["a", None], ids=[None, 1]), none).collect()] == [0.5, 0.5]
    assert quality_model.score_quality(documents(spark, []), none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(5, 5), (7, 6), (6, 7)]
    rng.shuffle(links)
    low = {x: x for ab in links for x in ab}
    for _ in range(200):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long"), Stage(spark, "t")).collect()}
    assert got == {x: c for x, c in low.items() if x in got} and all(x in got for a, b in links if a != b for x in (a, b))
