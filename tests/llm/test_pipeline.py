"""The pipeline's stages on small documents, and the registered queries against their SQL."""

import os

import pytest

import corpus_pipeline
from check import compare, connect
from corpus import awkward, prose
from seqloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "the house of the river and the red stone is in the old town that was built for this and it is on a hill by the sea "
WITH_SQL = [n for n, q in QUERIES.items() if q.sql is not None]


def table(spark, rows, folder):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i != 3), int(i == 4), 0) for i, _ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, extra int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages(spark, tmp_path):
    own = [(i, GOOD + prose(i, 120)) for i in range(10, 22)]
    rows = own + [(30, own[0][1]), (31, own[1][1]), (32, GOOD + prose(99, 50) + " token = 0123456789abcdef0123"), (40, "short"), (41, None)]
    docs = table(spark, rows, tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "secret scans", "mixing", "packing"]
    good, near, clean, mixed, _ = (f for _, f in corpus_pipeline.STAGES)
    kept = good(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {40, 41}
    single = near(spark, kept, str(tmp_path))
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {*range(10, 22), 32}
    redacted = {r.doc_id: r for r in clean(spark, single, str(tmp_path)).collect()}
    assert redacted[32].text.endswith(" [SECRET]") and redacted[32].n_chars == len(redacted[32].text)
    assert all(redacted[i].text == t and redacted[i].n_chars == len(t) for i, t in own)
    again = mixed(spark, single, str(tmp_path))
    assert again.columns == docs.columns
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in done} == {r.doc_id for r in again.collect()}
    assert all(r.offset + r.length <= 1024 for r in done)


@pytest.mark.parametrize("rows", [[], awkward()])
def test_odd_tables_do_not_stop_it(spark, tmp_path, rows):
    docs = table(spark, rows, tmp_path)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, name):
    message, n, _, _ = compare(spark, connect(SF), QUERIES[name], SF)
    assert message == "" and n > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WITH_SQL])
def test_query_has_rows(spark, name):
    assert QUERIES[name].run(spark, SF).count() > 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    """Different texts under one id both stay; a copy under it goes, and of repeated rows one stays."""
    a, b, c = (GOOD + prose(i, 120) for i in (50, 51, 52))
    rows = [(1, a), (5, b), (5, c), (5, a), (5, b), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in rows], SCHEMA + ", own string")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, c), (1, a), (5, b), (5, c)])
