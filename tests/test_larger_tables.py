"""What larger tables do to queries: nothing is worked out twice, handed on whole, or gathered in one task."""

import json
import random
import re

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__
from docgauge.functions.frames import SLICE, slices
from docgauge.operators import compare, metrics, retrieval

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_keeps_chunks_in_their_task(spark):
    found = plan(__spark_entry__.queries()["bm25_top"](spark, SF))
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, chunk_id", found)
    # A token that all chunks hold, a chunk id that stands twice, and a query without any hit.
    corpus = spark.createDataFrame([(str(i), "the cat " * (i % 3 + 1) + f"n{i}") for i in range(50)] + [("7", "the the n7 n7")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "the n7"), (2, "absent"), (3, "the the n9")], "query_id long, query string")
    few = retrieval.bm25(queries, corpus, 3, fill=False).orderBy("query_id", "rank").collect()
    limit, retrieval.FEW_TOKENS = retrieval.FEW_TOKENS, 0
    try:
        many = retrieval.bm25(queries, corpus, 3, fill=False).orderBy("query_id", "rank").collect()
    finally:
        retrieval.FEW_TOKENS = limit
    assert few == many and [r["chunk_id"] for r in few][:1] == ["7"] and {r["query_id"] for r in few} == {1, 3}


def test_batches_are_handed_on_in_slices(spark):
    long, none = "x" * SLICE, None
    assert list(slices(pd.Series([long, none, long, "a"], dtype=object), pd.Series(["", none, long, "b"], dtype=object))) == [(0, 1), (1, 3), (3, 4)]
    assert list(slices(pd.Series([], dtype=object))) == [] and list(slices(pd.Series([none, none], dtype=object))) == [(0, 2)]
    pairs = spark.range(9).select("id", F.repeat(F.lit("abc "), 30_000).alias("base"), F.concat(F.repeat(F.lit("abc "), 30_000), F.col("id").cast("string")).alias("target"))
    rows = compare.text_diffs(pairs.coalesce(1)).select("id", "added_count", "removed_count").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(i, 2, 0) for i in range(9)]


def test_chunk_bounds_are_found_once(spark):
    df = __spark_entry__.queries()["overlapping_chunks"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    texts = [None, "", "a", "x" * 50, "x" * 51, "ab\n" * 40, "é\n" * 30]
    blocks = spark.createDataFrame([("d", str(i), t) for i, t in enumerate(texts)], "document_id string, block_id string, text string")
    found = {}
    for r in retrieval.chunks(blocks, 50, 10).collect():
        found.setdefault(int(r["block_id"]), []).append((r["chunk_at"], r["start"], r["end"], r["chunk"]))
    assert {i: sorted(f) for i, f in found.items()} == {i: [(k, a, b, t[a:b]) for k, (a, b) in enumerate(retrieval.chunk_bounds(t, 50, 10))] for i, t in enumerate(texts) if t}


def test_tasks_follow_the_rows(spark, monkeypatch):
    from docgauge.functions import frames

    monkeypatch.setattr(frames, "TASK_ROWS", 10)
    assert frames.tasks_for(spark.range(995)) == 100
    for name, n in (("entity_scores", 600), ("answer_gate", 150)):
        assert re.search(rf"hashpartitioning\([^)]*, {n}\), REPARTITION_BY_NUM", plan(__spark_entry__.queries()[name](spark, SF)))


def test_digits_of_inversions_are_dealt_anew(spark):
    found = plan(__spark_entry__.queries()["crossed_lines"](spark, SF))
    assert re.search(r"hashpartitioning\(supplier#\d+L?, level#\d+, above#\d+L?, \d+\)", found)


def test_inversions_equal_brute_force(spark):
    import random

    from docgauge.operators import metrics

    random.seed(3)
    groups = {n: random.sample(range(1000), n) for n in (1, 2, 3, 4, 5, 16, 17, 64, 65, 200)}
    rows = spark.createDataFrame([(str(n), p, g) for n, gs in groups.items() for p, g in enumerate(gs)], "run_id string, p int, g int")
    found = {r["run_id"]: (r["n_matched"], r["n_inversions"]) for r in metrics.inversions(rows).collect()}
    assert found == {str(n): (n, sum(gs[i] > gs[j] for i in range(n) for j in range(i + 1, n))) for n, gs in groups.items()}


def test_evaluation_leaves_scores_only(spark, monkeypatch, tmp_path):
    """Payloads, pages, blocks and cells are gone when the scores of a group are written, and so are the shuffle files."""
    from docgauge.functions import frames

    query = __spark_entry__.queries()["payload_scores"]
    monkeypatch.setattr(frames, "checkpoint_folder", lambda spark: str(tmp_path))
    kept = query(spark, SF)
    stored = [spark.read.parquet(str(p)) for p in tmp_path.glob("docgauge-tables-*/*")]
    assert stored and all({"run_id"} < set(s.columns) and not {"pages", "gt_doc", "bbox", "text", "payload"} & set(s.columns) for s in stored)
    rows = sorted(kept.collect())
    monkeypatch.setattr(frames, "checkpoint_folder", lambda spark: None)
    assert rows == sorted(query(spark, SF).collect()) and len(rows) > 1000


def test_payloads_stay_where_lines_lie(spark):
    """One shuffle deals the lines of each side; JSON texts, pages and runs aren't dealt again."""
    from docgauge import queries_truth
    from docgauge.sources import payloads

    truth, _ = payloads.ground_truth(queries_truth.truth_payloads(spark, SF), "orders", "1", kept=False)
    read = payloads.typed(queries_truth.read_payloads(spark, SF), ["run_id", "document_id"], kept=False)
    joined = plan(read.join(truth.select("document_id", "pages").hint("merge"), "document_id"))
    assert joined.count("Exchange hashpartitioning") == joined.count("REPARTITION_BY_NUM") == 2


def test_boxes_stand_in_few_bands(spark, monkeypatch):
    """All pairs that overlap enough, each once, as brute force finds them; no box is repeated for more than a few bands."""
    draw = random.Random(4)
    sizes = [0.25, 1, 2, 3, 4, 5.5, 8, 1e-3, 1e6]
    boxes = lambda n: [(x, y, x + draw.choice(sizes), y + draw.choice(sizes)) for x, y in [(draw.randrange(4), draw.randrange(-40, 40) / 4) for _ in range(n)]]
    sides = boxes(150) + [(0, 0, 10, 4), (0, 0, 10, 8)], boxes(150) + [(0, 0, 10, 8), (0, 4, 10, 8), (0, 2, 10, 6)]
    kind = "run_id string, page_number int, type string, index int, bbox struct<x1: double, y1: double, x2: double, y2: double>"
    g, p = (spark.createDataFrame([("r", 1, "t", i, tuple(map(float, b))) for i, b in enumerate(side)], kind) for side in sides)

    def overlap(a, b):
        side = lambda lo, hi: max(0.0, min(a[hi], b[hi]) - max(a[lo], b[lo]))
        area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        shared = side(0, 2) * side(1, 3)
        return shared / (area(a) + area(b) - shared)

    for least in (0.2, 0.5, 0.75, 1.0):
        found = sorted((r["g"], r["p"]) for r in metrics.layout_candidates(g, p, least).collect())
        assert found == [(i, j) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[1]) if overlap(a, b) >= least]
    reached = []
    real = type(g).join
    monkeypatch.setattr(type(g), "join", lambda self, other, *args, **named: reached.append(other.count()) or real(self, other, *args, **named))
    metrics.layout_candidates(g, p)
    assert reached[0] <= 7 * len(sides[1])


def test_ground_truth_that_is_not_written(spark):
    """The same rows, whether payloads and rows are written first, or judged and read in one pass; a document with one broken payload is refused whole."""
    from docgauge.sources import payloads

    draw = random.Random(8)
    odd = [None, 5, "x", "7", [], {}, -1, True, 2.5, [{"type": "title", "text": "t"}], [{"cells": [{"row": 0, "column": "1"}]}], [{"cells": [{"row": "x"}]}], [{"start": 0, "end": 2, "type": "A"}], [{"start": 3, "end": 2, "label": "B"}]]
    made = lambda: json.dumps({"full_text": draw.choice(["text", "text", "", 5]), "pages": draw.choice([[{"blocks": draw.choice(odd[-6:]), "page_number": draw.choice([1, "2", "x"])}], [], [{"blocks": []}], odd]), "pii_entities": draw.choice(odd[-2:] + [[]])})
    rows = [(str(draw.randrange(250)), made()) for _ in range(300)] + [(None, "no json"), ("n", "no json"), ("n", '{"full_text": "", "pages": []}'), (None, '{"full_text": "", "pages": []}'), ("z", None)]
    raw = spark.createDataFrame(rows, "document_id string, payload string")
    (kept, broken), (passed, told) = payloads.ground_truth(raw, "d", "1"), payloads.ground_truth(raw, "d", "1", kept=False)
    listed = lambda df: sorted(map(str, df.collect()))
    assert listed(kept) == listed(passed) and len(listed(kept)) > 20
    assert listed(broken) == listed(told) and {"n", "z"} <= {r["document_id"] for r in broken.collect()}
