"""The pipeline against a version in DuckDB and plain Python, and the registered statements."""

import pytest

import corpus_pipeline
from checks.compare import compare, duck, rows_of
from quantfold.llm import secret_scan
from quantfold.llm.queries import llm_queries
from quantfold.llm.statements import QUALITY_RULES, SOURCE_MIXING, llm_statements
from helpers_llm import groups, shingles
from test_decontaminate import brute


def test_run_against_brute_force(spark, sf_dir):
    con = duck(sf_dir)
    docs = {r[0]: r[1:] for r in con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()}
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({QUALITY_RULES}) WHERE kept").fetchall()}
    comp = groups({i: shingles(docs[i][0], 5) for i in good}, 80, 100)
    single = sorted(i for i in good if comp[i] == i or not shingles(docs[i][0], 5))
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    clean = [i for i, (_, n_hit, _) in zip(single, brute([docs[i][0] for i in single], items)) if not n_hit]
    last = [(i, secret_scan.redacted(docs[i][0], secret_scan.spans_of(docs[i][0])), docs[i][2]) for i in clean]
    assert len(docs) > len(good) > len(single) > len(clean)
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", last)
    cur = con.execute(f"SELECT * FROM ({SOURCE_MIXING}) WHERE copies > 0")
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    df = corpus_pipeline.run(spark, sf_dir)
    assert compare(rows_of(df.columns, [tuple(r) for r in df.collect()]), want, tol=1e-9) is None


def test_stages_keep_the_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in corpus_pipeline.STAGES[:2] + corpus_pipeline.STAGES[3:4]:
        assert step(spark, empty, "").columns == empty.columns, name


@pytest.mark.parametrize("name", sorted(llm_statements()))
def test_query_matches_duckdb(spark, sf_dir, name):
    df = llm_queries()[name](spark, sf_dir)
    cur = duck(sf_dir).execute(llm_statements()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[1] and compare(got, want, tol=1e-9) is None
