"""The pipeline against a brute-force version of its stages."""

from collections import defaultdict

import corpus_pipeline
from tests.llm.test_near import brute_kept
from tests.llm.test_operators import best_fit_decreasing, brute_contaminated, brute_fingerprint, classes

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    from docgauge.llm.quality import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality(docs).filter("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    holders = defaultdict(set)
    for doc, text in texts.items():
        for line in text.split("\n"):
            holders[key(line)].add(doc)
    texts = {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == d) for d, t in texts.items()}
    component = classes({d: brute_fingerprint(t) for d, t in texts.items()})
    texts = {d: t for d, t in texts.items() if component[d] == d}
    benchmark = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, t in texts.items() if not any(b in " ".join(t.split()) for b in benchmark)}

    rows = corpus_pipeline.run(spark, SF).collect()
    # Line dedup may have cut a passage, of which most is still a leak.
    found = {r["doc_id"] for r in rows}
    assert found <= clean and len(clean - found) <= 3
    assert len({r["sequence_id"] for r in rows}) == best_fit_decreasing([r["length"] for r in rows], 2048)


def test_stages_equal_brute_force_exactly(spark):
    """Line dedup, near-dedup by Jaccard similarity and decontamination of what the quality rules keep, each by brute force; no document more or less."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = corpus_pipeline.quality_rules(spark, docs, SF)
    texts = {r["doc_id"]: r["text"] or "" for r in judged.collect()}
    assert 0 < len(texts) < docs.count()
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    holders = defaultdict(set)
    for doc, text in texts.items():
        for line in text.split("\n"):
            holders[key(line)].add(doc)
    texts = {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == d) for d, t in texts.items()}
    texts = {d: texts[d] for d in brute_kept(texts)}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    leaks = {d for d, _ in brute_contaminated(texts, items)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts) - leaks
