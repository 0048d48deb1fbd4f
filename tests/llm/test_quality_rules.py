from collections import Counter

from quantfold.llm import quality_rules
from quantfold.llm.quality_rules import filter_documents
from helpers_llm import documents, words


def brute(t):
    w, t = words(t), t or ""
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = set()
    for i in range(len(w) - 4):
        if wins[tuple(w[i : i + 5])] > 1:
            cover |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))


TEXTS = [
    None, "", " \n\t ", "a b", "a b c d e a b c d e x", "l one\nl one\n\n  \nl one \n", "é ü ñ # $$$ <b>", "w " * 30,
    " ".join(f"w{i}" for i in range(20_000)) + " w1 w2 w3 w4 w5 w6", "😀 \x0b x\x0c y", " ".join("abcdefghij"),
]


def test_measures(spark):
    docs = documents(spark, TEXTS)
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)


def test_limits_follow_the_group(spark):
    clean = [" ".join(f"w{i}x{k}" for i in range(15)) for k in range(60)]
    coded = [" ".join(f"<w{i}x{k}>" for i in range(15)) for k in range(60)]
    texts = clean + ["$$$ ".join(f"w{i}" for i in range(15))] + coded
    sources = ["prose"] * 61 + ["code"] * 60
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, texts, sources=sources), min_docs=50).collect()}
    assert all(got[i].kept for i in range(60)) and not got[60].kept
    assert all(got[i].kept and got[i].sketch_level == 2 for i in range(61, 121))
    few = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, texts, sources=sources), min_docs=10_000).collect()}
    assert {r.sketch_level for r in few.values()} == {0}


def test_null_groups_and_repeats(spark):
    docs = documents(spark, ["a b c d e f g h i j"] * 3, ids=[1, 1, None], langs=[None, "en", None], sources=[None, None, "s"])
    out = quality_rules.quality_rules(docs)
    assert out.count() == 3 and out.filter("kept").count() == 3
    kept = filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 3


def test_filters_on_measures_do_not_repeat_them(spark):
    docs = documents(spark, [" ".join(f"w{i}" for i in range(3000))] * 4)
    assert quality_rules.quality_rules(docs).filter("n_repeat_words = 0 AND kept").count() == 4


def test_empty_table(spark):
    assert quality_rules.quality_rules(documents(spark, [])).count() == 0
    assert filter_documents(documents(spark, [])).count() == 0


def prose(k, n=30):
    return " ".join("abcdefghij"[: 3 + (i * 7 + k) % 6] for i in range(n)) + f" doc {k}"


def test_a_source_of_mostly_zeros_and_one_of_mostly_junk(spark):
    junk = [" ".join("#$%x" if i % 3 else f"w{k}y{i}" for i in range(30)) for k in range(70)]
    texts = [prose(k) for k in range(300)] + junk + [prose(400 + k) for k in range(10)]
    sources = ["zero"] * 300 + ["junk"] * 80
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, texts, sources=sources), min_docs=50).collect()}
    assert all(r.sketch_level == 2 for r in got.values())
    # no symbols at all: only the slack is left of the limit
    assert got[0].symbol_pm_limit == 20 and all(got[i].kept for i in range(300) if not got[i].base_failed)
    # three quarters of junk do not set their own limit
    assert got[300].symbol_pm > got[300].symbol_pm_limit and not any(got[i].kept for i in range(300, 370))
    assert all(got[i].kept for i in range(370, 380) if not got[i].base_failed)


def test_more_than_one_limit_on_the_test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert quality_rules.quality_rules(docs, min_docs=15).select("space_pm_least", "space_pm_limit").distinct().count() > 1


def test_columns_of_any_name_pass_through(spark):
    docs = documents(spark, [prose(k) for k in range(3)]).withColumnRenamed("token", "a.b").withColumnRenamed("node", "n_words").withColumnRenamed("u", "doc").withColumnRenamed("kept", "_words")
    kept = filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 3


def test_limits_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality_rules.quality_rules(docs, min_docs=12).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()

    def bin_of(v):
        return v - v % next((step for edge, step in ((64, 1), (128, 2), (256, 4), (512, 8)) if v < edge), 16)

    def fence(group, measure):
        v = sorted(bin_of(getattr(r, measure)) for r in group)
        q1, q3 = (v[-(-len(v) * k // 4) - 1] for k in (1, 3))
        two, slack = quality_rules.MEASURES[measure]
        reach = quality_rules.SPREAD * (q3 - q1) + slack
        return (max(q1 - reach, 0), q3 + reach) if two else (0, q3 + reach + q3 // 4)

    for r in rows:
        for measure in quality_rules.MEASURES:
            lo, hi = fence(rows, measure)
            for group in ([x for x in rows if x.lang == r.lang], [x for x in rows if (x.lang, x.source) == (r.lang, r.source)]):
                if len(group) >= 12:
                    a, b = fence(group, measure)
                    lo, hi = max(a, lo - (hi - lo)), min(b, hi + (hi - lo))
            assert (r[f"{measure}_least"], r[f"{measure}_limit"]) == (lo, hi)
