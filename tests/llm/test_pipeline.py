"""The pipeline's stages against each other and the driver contract of the text queries."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import queries
from tools.check_queries import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mixing", "byte_bpe"]


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert compare(queries.QUERIES[name](spark, FOLDER), con.execute(queries.SQL[name])).startswith("ok")


@needs_data
def test_stages_keep_columns_and_reread(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == columns
        if name != "source_mixing":
            assert out.count() == out.select("doc_id").distinct().count() and out.count() <= n
            assert out.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
        docs, n = out, out.count()
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert tokens.count() == n and tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


#: Names that the stages use inside or add.
INNER = ("rate", "copy", "place", "mix_group", "n", "_n", "key", "chars", "want", "kept", "rejected_by", "n_words", "_n_words", "_word_chars",
         "_spot", "spot", "digest", "rest", "e", "keep_id", "last_rows", "pieces", "known", "in_0", "in_1", "class", "component")


def test_stages_with_columns_named_as_their_own(spark):
    body = [" ".join(f"word{(7 * i + k) % 391} text" for k in range(60)) for i in range(12)]
    rows = [(i, t, f"src{i % 4}") for i, t in enumerate(body)] + [(50, body[0], "src0"), (51, "short", None), (None, None, None), (52, body[1] + " tail", "src1")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    named = spark.createDataFrame([(*r, *[f"own {r[0]}"] * len(INNER)) for r in rows], ", ".join(
        ["doc_id long", "text string", "source string", *[f"`{c}` string" for c in INNER]]))
    for name, stage in corpus_pipeline.STAGES:
        if name == "byte_bpe":
            assert sorted(stage(spark, named, FOLDER).collect()) == sorted(stage(spark, plain, FOLDER).collect())
            continue
        got, want = stage(spark, named, FOLDER), stage(spark, plain, FOLDER)
        assert got.columns == named.columns
        seen = got.collect()
        order = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
        assert [tuple(r)[:3] for r in sorted(seen, key=order)] == [tuple(r) for r in sorted(want.collect(), key=order)] and seen
        assert all(set(tuple(r)[3:]) == {f"own {r.doc_id}"} for r in seen)
        named, plain = spark.createDataFrame(seen, got.schema), want
