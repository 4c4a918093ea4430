"""Registered queries: against SQL where SQL can express them, else in shape."""

from __future__ import annotations

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from checks.compare import difference, duckdb_rows
from labreports.llm.common import written
from labreports.llm.decontaminate import normal_bytes, shingles_of
from labreports.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL

COLUMNS = {
    "op2_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_simhash": ["doc_id", "fingerprint", "component_id"],
    "op4_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op6_main_text": ["page_id", "url", "text", "n_chars"],
    "op7_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op10_quality": ["doc_id", "held_out", "score", "predicted"],
    "op11_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score".split(),
}


def test_every_operator_is_registered():
    names = registered.queries()
    assert [sum(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(COLUMNS) | set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    result = QUERIES[name](spark, SMALL).toArrow()
    assert difference(result, duckdb_rows(ORACLE_SQL[name], SMALL)) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    result = QUERIES[name](spark, SMALL)
    assert result.columns == COLUMNS[name]
    source = {"op4_neighbours": "embeddings", "op6_main_text": "pages"}.get(name, "documents")
    rows = spark.read.parquet(f"{SMALL}/{source}.parquet")
    if name == "op4_neighbours":
        rows = rows.where("vec_id % 50 = 0")
        assert result.count() == 5 * rows.count()
    else:
        assert result.count() == rows.count()


def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    source, items = docs, spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = written(stage(spark, docs, SMALL), "stage")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after and after <= before
        seen.append(len(before) - len(after))
        if k < 4:
            assert docs.columns == source.columns
        if k == 3:
            for row in docs.collect():
                words = f" {' '.join(normal_bytes(row.text).decode().split())} "
                for shingles in (shingles_of(item.text) for item in items):
                    assert sum(f" {s} " in words for s in shingles) < 0.8 * len(shingles)
    assert seen[0] > 0 and seen[1] == 0 and seen[2] > 0 and seen[3] > 0 and seen[4] == 0
    result = registered.queries()["pipeline"](spark, SMALL)
    assert {r.doc_id for r in result.select("doc_id").collect()} == after


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, odd, name, stage):
    result = stage(spark, odd, SMALL)
    kept = [r.doc_id for r in result.collect()]
    if name == "quality classifier":  # decides by the text alone, and keeps the columns
        assert result.columns == odd.columns
        texts = {r.doc_id: r.text for r in odd.collect()}
        alike = [k for k in (1, 2, 6) if not texts[k]]
        assert len({k in kept for k in alike}) == 1 and kept.count(4) in (0, 2)
    else:
        assert 5 in kept and None in kept
    assert stage(spark, odd.limit(0), SMALL).count() == 0


def test_near_dedup_keeps_one_document_of_each_group(spark, documents):
    """Copies of the longer kind, texts without words, and texts that are alike in no way."""
    text = " ".join(f"word{k % 300}" for k in range(2_000))
    rows = [(k, text) for k in (7, 3, 9)] + [(20, None), (21, "  "), (4, "one text"), (5, "another one"), (None, text)]
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert sorted(str(r.doc_id) for r in stage(spark, documents(rows), SMALL).collect()) == ["20", "3", "4", "5", "None"]
