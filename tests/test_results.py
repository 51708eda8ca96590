"""Queries over derived vendor results, gates and records against their SQL, and literal cases of what they use."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docgauge.operators import masking, normalize, retrieval
from docgauge.queries_results import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    """Rows in order, numbers to six places."""

    def value(v):
        if v is None or isinstance(v, str | bool):
            return str(v)
        return f"{float(v):.6g}" if hasattr(v, "__float__") else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations", "events", "orders", "lineitem", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [*QUERIES, "whole_text_scores", "leaderboard_of_variants", "corpus_statistics", "bm25_top"])
def test_query_equals_sql(name, spark, duck):
    found = __spark_entry__.queries()[name](spark, SF)
    cursor = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    rows = found.collect()
    assert rows and plain(rows, found.columns) == plain(cursor.fetchall(), columns)


def test_vendor_summary_looks_at_any_depth(spark):
    raw = [
        '{"result": {"detectedEntityCount": 3, "maskedEntityCount": 2, "maskedText": "m"}}',
        '{"detected_entity_count": true, "x": [{"detectCount": 4.7}], "content": 5, "y": {"content": "c"}}',
        '{"a": {"detections": [1, 2, 3]}, "items": [1]}',
        '"text"',
        None,
    ]
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select(masking.vendor_summary(F.col("raw")).alias("v")).collect()
    assert [tuple(r["v"]) for r in rows] == [(3, 2, "m"), (4, 4, "c"), (1, 1, ""), (None, None, None), (None, None, None)]


def test_content_list_takes_the_first_object(spark):
    item = lambda t: {"content_list": [{"type": "text", "text": t, "page_idx": 0}]}
    raw = [json.dumps({"results": {"z.pdf": item("first"), "a.pdf": item("second")}}), json.dumps({"results": {"a": "str", "b": item("object")}}), json.dumps({"results": {}})]
    rows = normalize.content_list(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()
    assert [r["full_text"] for r in rows] == ["first", "object", ""]


def test_evidence_must_be_texts(spark):
    text = '{"answer": "x", "evidence_chunk_ids": [1, "2"]}'
    rule = spark.range(1).select(retrieval.parsed_answer(F.lit(text), F.array(F.lit("1"), F.lit("2"))).alias("p")).first()["p"]["rule"]
    assert rule == "evidence_not_strings"


def test_trees_and_chunks_without_recursion():
    deep = "x"
    for _ in range(5000):
        deep = {"content": [deep, {"text": " "}]}
    assert normalize._tree_text(deep) == "x"
    assert normalize._tree_text({"text": " ", "blocks": [], "children": ["a", {"full_text": "b", "text": "c"}]}) == "a\nb"
    text = "\n".join("line %d" % i for i in range(3000))
    bounds = retrieval.chunk_bounds(text, 500, 40)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text) and all(b <= e for (_, e), (b, _) in zip(bounds, bounds[1:])) and max(e - b for b, e in bounds) <= 500
    assert all(text[e] == "\n" for _, e in bounds[:-1])


def test_evaluation_of_long_documents(spark):
    """A page number past what fits an index of pages times blocks, and many blocks on one page."""
    from docgauge.plans.evaluate import evaluate
    from docgauge.schemas import ENTITIES, PAGES

    block = lambda i: (f"b{i}", "paragraph", 30_000, i, f"text {i}", (0.0, 20.0 * i, 10.0, 20.0 * i + 10), None, None, None, None, None)
    pages = [(30_000 + n, None, None, "", [block(i) for i in range(50)] if n == 0 else []) for n in range(2)]
    predictions = spark.createDataFrame([("r", "d", "t", pages)], f"run_id string, document_id string, full_text string, pages {PAGES}")
    truth = spark.createDataFrame([("d", "t", pages, [])], f"document_id string, full_text string, pages {PAGES}, pii_entities {ENTITIES}")
    row = evaluate(predictions, truth).first()
    assert row["layout_matches_iou50"] == 50 and row["reading_order_accuracy"] == 1.0 and row["reading_order_matched_blocks"] == 50


@pytest.mark.parametrize("name", ["tree_results", "pipeline_results", "content_list_results"])
def test_normalizers_run_once(name, spark):
    """No filter in front of the blocks works out the normalized pages by itself."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(transform(" not in plan and "Filter ((size(transform(" not in plan


def test_blocks_of_null_and_empty_pages(spark):
    from docgauge.operators.structure import blocks_of
    from docgauge.schemas import PAGES

    block = ("b", "paragraph", 7, 0, "t", None, None, None, None, None, None)
    docs = [("none", None), ("empty", []), ("bare", [(1, None, None, "", None), (2, None, None, "", [])]), ("two", [(1, None, None, "", [block, None]), (9, None, None, "", [block])])]
    rows = blocks_of(spark.createDataFrame(docs, f"run_id string, pages {PAGES}"), ["run_id"]).select("run_id", "page_number", "page_at", "source_index", "id").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("two", 1, 0, 0, "b"), ("two", 1, 0, 1, None), ("two", 9, 1, 0, "b")], key=str)
