"""Named queries against their SQL counterparts at the smallest scale, and rules about the code."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest

from tools.check import TABLES, rows_of
from topicloom.queries.registry import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
FAST = [
    "clean_text", "preprocess_stats", "tokenize", "chunk_documents", "topic_info", "topic_distribution", "attach_topics", "ctfidf",
    "sentiment_labels", "split_by_sentiment", "merge_small_topics", "knn_in_topic", "semantic_search", "sample_positions", "parse_labels",
    "export_topic_info", "index_roundtrip", "top_topics_others",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, duck, name):
    df = all_queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(all_oracles()[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


def test_no_local_checkpoint_and_no_pandas_collect():
    root = Path(__file__).resolve().parents[1] / "topicloom"
    for path in root.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and not re.search(r"\.toPandas\(", text), path
