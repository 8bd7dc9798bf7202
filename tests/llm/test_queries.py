"""Every query with an SQL twin on whole tables against DuckDB; columns of the others."""

from __future__ import annotations

import os

import duckdb
import pytest

from patronage.llm.oracle import ORACLE
from patronage.llm.queries import QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_language": ["doc_id", "held_out", "lang_pred", "score", "rejected"],
    "op5_main_text": ["page_id", "url", "text", "n_chars"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op13_simhash": ["doc_id", "fingerprint", "component_id"],
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    expected = connection.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    ours = sorted((tuple(row[column] for column in columns) for row in found.collect()), key=repr)
    assert ours == sorted(expected, key=repr)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_other_queries(spark, name):
    found = QUERIES[name](spark, FOLDER)
    assert found.columns == COLUMNS[name]
    table = "pages" if name == "op5_main_text" else "documents"
    assert found.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_all_queries_are_tested():
    assert set(QUERIES) == set(ORACLE) | set(COLUMNS)
