"""Columns of the caller's that are named like an operator's own, in either case; and the whole pipeline against its stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pellucid.llm import html_mincut, url_markov

HTML = "<html><body><article><p>The river rose in the night, and by morning the lower fields were under water, as the old people had said it would.</p></article></body></html>"


@pytest.mark.parametrize("case", [str.lower, str.upper])
def test_extraction_beside_other_columns(spark, case):
    rows = spark.createDataFrame([(1, "u", HTML, "old", 7, "kept"), (2, None, None, None, None, None)], f"page_id long, url string, html string, {case('text')} string, {case('n_chars')} int, other string")
    got = html_mincut.extracted(rows)
    assert sorted(c.lower() for c in got.columns) == ["n_chars", "other", "page_id", "text", "url"]
    by_id = {r["page_id"]: r for r in got.select("page_id", "text", "n_chars", "other").collect()}
    assert "river" in by_id[1]["text"] and by_id[1]["n_chars"] == len(by_id[1]["text"]) and by_id[1]["other"] == "kept" and by_id[2]["text"] == ""


@pytest.mark.parametrize("case", [str.lower, str.upper])
def test_url_verdicts_beside_other_columns(spark, case):
    names = ("host", "path", "rule", "verdict", "ratio", "_rule", "fits")
    urls = [f"https://www.site{k}.com/a/{k}" for k in range(20)] + [f"http://x{k}.net/es/{k}" for k in range(20)] + [None, "none"]
    plain = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    clash = plain.withColumns({case(c): F.lit("own") for c in names})
    want = {r["page_id"]: tuple(r) for r in url_markov.judged(plain).select("page_id", "host", "path", "rule", "verdict").collect()}
    got = url_markov.judged(clash)
    assert {r["page_id"]: tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()} == want
    assert {r[0] for r in got.select(case("fits")).distinct().collect()} == {"own"}


@pytest.mark.parametrize("case", [str.lower, str.upper])
def test_language_stage_keeps_foreign_columns(spark, data, case):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    own = docs.withColumns({case("score"): F.lit(0.5), case("lang_pred"): F.lit("zz"), "part": F.lit(1)})
    got = corpus_pipeline.language(spark, own, data)
    assert got.columns == own.columns
    assert {tuple(r) for r in got.select(case("score"), case("lang_pred"), "part").distinct().collect()} == {(0.5, "zz", 1)}
    assert {r[0] for r in got.select("doc_id").collect()} == {r[0] for r in corpus_pipeline.language(spark, docs, data).select("doc_id").collect()}


def test_run_is_the_chain_of_its_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(corpus_pipeline.run(spark, data)) == key(docs)
