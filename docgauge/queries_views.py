"""Files, integrity, percentiles, differences, spans and research views as queries over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions.columns import config_hash
from docgauge.operators import benchmark, compare, gates, integrity, masking, normalize, operations, repair, retrieval, structure
from docgauge.sources import files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(by: Column, *of: str) -> Column:
    return F.element_at(F.array(*map(F.lit, of)), (by + 1).cast("int"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several extensions in folders of ten."""
    d = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    name = F.concat(F.lit("runs/"), F.floor(d / 10).cast("string"), F.lit("/"), d.cast("string"), _pick(d % 5, ".PDF", ".md", ".txt", ".exe", ""))
    content = F.encode("text", "utf-8")
    return rows.select("doc_id", name.alias("path"), content.alias("content"), F.octet_length("text").cast("long").alias("length"))


def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with extension, size, digest and the rule that refuses them."""
    declared = F.when(F.col("doc_id") % 7 == 0, "text/html").when(F.col("doc_id") % 7 == 1, "application/octet-stream")
    rows = files.catalog(_files(spark, sf_dir), 3000, declared)
    return rows.select("path", "name", "extension", "size_bytes", "sha256", "rule")


def outputs_of_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first readable file of each extension in each folder."""
    rows = files.first_outputs(_files(spark, sf_dir))
    return rows.select("run", "extension", "path", F.md5("text").alias("text_md5"))


def pages_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages over several JSON result files of an order: one with pages inside a result, one a list, one a bare object, one unreadable."""
    n = F.col("order")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"))
    texts = [F.concat(F.lit('{"result": {"pages": [{"a": '), n.cast("string"), F.lit('}, {"a": 2}]}}')), F.concat(F.lit('[{"b": '), (n % 3).cast("string"), F.lit("}]")), F.lit('{"c": 3}'), F.lit("not json")]
    each = orders.select("order", F.posexplode(F.array(*texts)).alias("at", "text")).withColumn("name", F.concat(F.lit("f"), F.col("at").cast("string")))
    rows = files.result_pages(each.filter((F.col("order") + F.col("at")) % 4 != 0), ["order"])
    return rows.select("order", F.col("page_number").cast("long").alias("page_number"), "page")


def artifact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of results by media type, each path counted once a run, and all of them."""
    e = F.col("event_id")
    artifact = lambda path, size, kind: F.struct(F.lit("n").alias("name"), path.alias("path"), F.lit(kind).alias("media_type"), size.cast("long").alias("size_bytes"), F.lit("s").alias("source"), F.lit(False).alias("archive_entry"))
    results = _table(spark, sf_dir, "events").select(e.cast("string").alias("run_id"), F.array(artifact(F.lit("p"), e, "text/plain"), artifact(F.lit("p"), e, "text/plain"), artifact(F.lit("q"), e % 10, "image/png")).alias("artifact_manifest"))
    each = files.artifacts(results).groupBy("run_id").agg(F.count("*").alias("n_artifacts"), F.count_if(F.col("media_type") == "image/png").alias("n_images"))
    return each.join(operations.result_sizes(results).hint("shuffle_hash"), "run_id")


def merged_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations of a connector, a run and a request merged, with their digests."""
    n = F.col("o_orderkey")
    base = F.concat(F.lit('{"b": {"x": 1, "y": '), (n % 3).cast("string"), F.lit('}, "a": "'), F.col("o_orderstatus"), F.lit('"}'))
    own = F.when(n % 4 != 0, F.concat(F.lit('{"b": {"y": '), (n % 5).cast("string"), F.lit("}}")))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", normalize.merged_config(base, own, F.when(n % 2 == 0, F.lit('{"b": 7}'))).alias("config"))
    return rows.select("o_orderkey", "config", config_hash(F.col("config")).alias("config_hash"))


def percentiles_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of event values by type."""
    rows = _table(spark, sf_dir, "events")
    found = benchmark.percentiles(rows, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p100": 1.0})
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p100")])


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    d = F.col("doc_id")
    later = rows.filter(d % 77 != 5).withColumn("lang", F.when(d % 50 == 3, "xx").otherwise(F.col("lang"))).withColumn("doc_id", F.when(d % 91 == 7, -d).otherwise(d))
    return rows, later


def dataset_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a later version of them: keys that were added, removed or changed."""
    return integrity.changed_rows(*_versions(spark, sf_dir), ["doc_id"])


def changed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the hash trees of two versions: rows of both at the root, and whether what has changed lies below what has changed."""
    before, after = (integrity.hash_tree(t, ["doc_id"], 6) for t in _versions(spark, sf_dir))
    nodes = integrity.changed_nodes(before, after)
    root = nodes.filter("level = 0").select("rows_before", "rows_after")
    leaves = nodes.filter("level = 6").select(F.call_function("shiftright", "node", F.lit(1)).alias("node")).distinct()
    above = nodes.filter("level = 5").select("node", F.lit(1).alias("there"))
    whole = leaves.join(above.hint("shuffle_hash"), "node", "full_outer").agg(F.bool_and(F.col("there").isNotNull()).alias("paths_hold"))
    return root.join(F.broadcast(whole))  # a row each


def rebuilt_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of successive turns put together again from their differences."""
    a = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("base"))
    pairs = a.join(a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("base").alias("target")).hint("merge"), ["conv_id", "turn"])
    rows = compare.text_diffs(pairs, normalize=False)
    joined = lambda *kinds: F.md5(F.array_join(F.transform(F.filter("diff", lambda p: p["type"].isin(*kinds)), lambda p: p["text"]), ""))
    size = lambda kind: F.aggregate(F.filter("diff", lambda p: p["type"] == kind), F.lit(0), lambda n, p: n + F.length(p["text"]))
    counted = (F.col("added_count") == size("added")) & (F.col("removed_count") == size("removed"))
    return rows.select("conv_id", "turn", joined("equal", "removed").alias("base_md5"), joined("equal", "added").alias("target_md5"), counted.alias("counts_hold"))


def span_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and numbers in short texts: places, counts and the masked text."""
    n = F.col("o_orderkey")
    text = F.concat(F.lit("see a"), n.cast("string"), F.lit("@ex.org or "), F.when(n % 3 == 0, F.concat(F.lit("010-1234-"), F.lpad((n % 10000).cast("string"), 4, "0"))).otherwise("nothing"), F.lit(" now"))
    rows = masking.deidentify(_table(spark, sf_dir, "orders").select(n.cast("string").alias("run_id"), text.alias("text")))
    place = lambda e: F.concat_ws(":", e["type"], e["start"].cast("string"), e["end"].cast("string"))
    return rows.select("run_id", F.array_join(F.transform("entities", place), ",").alias("places"), "deidentified_text", F.col("detected_entity_count").cast("long").alias("detected_entity_count"), F.col("output_characters").cast("long").alias("output_characters"))


def masking_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that each run masks, by its kind of input."""
    d = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("original"), F.when(d % 3 == 0, " ").otherwise(F.col("lang")).alias("text"), F.lit(None).cast("string").alias("markdown"), F.col("text").alias("full_text"))
    chosen = masking.masking_input(_pick(d % 4, "ORIGINAL", "TEXT", "MARKDOWN", "CANONICAL_JSON"))
    return rows.select("doc_id", F.md5(chosen).alias("input_md5"))


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("r").alias("run_id"), F.lit("p").alias("parser_name"), F.lit("1").alias("parser_version"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    pages = structure.text_pages(F.col("text"), separator="\n")
    bare = F.transform(pages, lambda p: p.withField("blocks", F.slice(p["blocks"], 1, 0)))
    return rows.withColumn("pages", F.when(F.col("doc_id") % 2 == 0, pages).otherwise(bare))


def blocks_for_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat blocks of canonical documents; half of the documents have pages without blocks."""
    rows = structure.research_blocks(_canonical(spark, sf_dir))
    return rows.select("block_id", "document_id", F.col("page_number").cast("long").alias("page_number"), "canonical_block_id", "block_type", F.col("reading_order").cast("long").alias("reading_order"), F.md5("text").alias("text_md5"))


def chosen_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on chosen documents, those that name other documents too, and chosen documents without any."""
    n = F.col("o_orderkey")
    evidence = lambda a, b: F.struct(a.cast("string").alias("doc_name"), b.cast("string").alias("evidence_doc_name"))
    doc = F.concat(F.lit("d"), (n % 10).cast("string"))
    rows = _table(spark, sf_dir, "orders").select(F.floor(n / 2).cast("string").alias("question_id"), doc.alias("doc_name"), F.when(n % 4 != 0, F.array(evidence(doc, F.lit(None)), evidence(F.lit(None), F.when(n % 3 == 0, F.lit("d0")).otherwise(doc)))).alias("evidence"))
    chosen, excluded, broken = gates.select_questions(rows, ["d1", "d2", "d4", "none"])
    counted = lambda df, name: df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return counted(chosen, "chosen").union(counted(excluded, "excluded")).union(broken.groupBy(F.col("rule").alias("part")).agg(F.count("*").alias("n")))


def grid_of_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of two repeats of each source in their shuffled order."""
    cases = _table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("case_id"))
    return repair.conditions_grid(cases, 2).withColumns({"repeat_id": F.col("repeat_id").cast("long"), "place": F.col("place").cast("long")})


def runs_of_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the names that their connectors have now, searched by name."""
    runs = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("parser_id"))
    connectors = _table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("parser_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("model_version"), F.lit("http").alias("adapter"))
    named = operations.with_snapshots(runs, connectors.hint("shuffle_hash"))
    return operations.search(named, "BUILDING", "parser_version", "parser_name").select("o_orderkey", "parser_name", "parser_version")


def upserted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of customers, some of which are written over or added."""
    table = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    changes = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.lit(1.0).alias("score"))
    return operations.upsert(table, changes, ["id"])


def inputs_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of documents packed into batches, each batch as one text with headers."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("block_id"), F.coalesce("text", F.lit("")).alias("text"))
    packed = retrieval.batches(retrieval.segments(rows, 1000), ["doc_id"], ["segment_at"], 4000)
    return retrieval.batch_texts(packed, ["doc_id"], ["segment_at"], ["block_id"]).select("doc_id", F.col("batch").cast("long").alias("batch"), F.md5("input").alias("input_md5"))


def runner_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads for a runner made of documents, broken in several ways by number."""
    d = F.col("doc_id")
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    block = lambda more="", number="1": F.concat(F.lit(f'{{"block_id": "b", "document_id": "d", "page_number": {number}, {more}'), F.substr(text, F.lit(2), F.length(text)))
    question = '{"question_id": "q", "document_id": "d", "question": "?"}'
    payload = lambda blocks, questions=question, head='"schema_version": 1, "repeat_id": 0': F.concat(F.lit(f'{{{head}, "blocks": ['), blocks, F.lit(f'], "questions": [{questions}]}}'))
    shapes = [
        payload(block()), F.lit("[]"), payload(block(), head='"schema_version": 2, "repeat_id": true'), payload(F.lit(""), ""), payload(F.concat(block(), F.lit(", 7"))), payload(block('"secret": 1, ')),
        payload(F.lit('{"block_id": "b", "page_number": 1, "text": "t", "document_id": 5}, {"block_id": "c", "page_number": 1, "document_id": "d"}')), payload(block(number="0")), payload(F.concat(block('"run_id": 3, '), F.lit(", "), block(number="true"))),
        payload(block(), f'{question}, {question[:-1]}, "answer": "x"}}'), payload(block(), '{"question_id": "q", "document_id": "other", "question": 1}'), payload(block(), head='"schema_version": 1, "repeat_id": 0, "gold": 1'),
    ]
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*shapes), (d % len(shapes) + 1).cast("int")).alias("payload"))
    found = gates.runner_violations(rows, ["doc_id"], ("block_id", "document_id", "page_number", "text", "run_id"))
    return found.select("doc_id", "rule")


def execution_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of orders whose frozen case or outputs were changed after they ended."""
    n = F.col("o_orderkey")
    case = F.concat(F.lit('{"b":'), n.cast("string"), F.lit(', "a": 1}'))
    digest = lambda plain: F.sha2(plain, 256)
    orders = _table(spark, sf_dir, "orders")
    runs = orders.select(n.cast("string").alias("run_id"), F.when(n % 5 == 0, "failed").otherwise("complete").alias("status"), case.alias("frozen_case"), digest(F.concat(F.lit('{"a":1,"b":'), F.when(n % 7 == 0, 0).otherwise(n).cast("string"), F.lit("}"))).alias("case_sha256"))
    records = orders.select(F.when(n % 11 == 0, -n).otherwise(n).cast("string").alias("run_id"), F.concat(F.lit("e"), n.cast("string")).alias("execution_id"), F.lit('{"y": [1, 2], "x": "t"}').alias("response"), digest(F.when(n % 3 == 0, '{"x":"t","y":[1,2]}').otherwise('{"x":"t"}')).alias("output_sha256"))
    return gates.execution_violations(runs, records)


def pages_of_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page results of a pipeline: blocks, OCR lines or markdown of three kinds, whichever a page has."""
    d = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("s")).alias("source"), F.coalesce("lang", F.lit("l")).alias("lang"))
    blocks = F.concat(F.lit('{"res": {"parsing_res_list": [{"block_content": "'), F.col("source"), F.lit('"}, {"block_content": ""}, 5, {"block_content": "b"}]}, "markdown": {"markdown_texts": ["m", "'), F.col("lang"), F.lit('"]}}'))
    lines = F.concat(F.lit('{"parsing_res_list": [], "overall_ocr_res": {"rec_texts": ["'), F.col("lang"), F.lit('", "line"]}, "markdown": "whole"}'))
    plain = F.lit('{"markdown": {"markdown_texts": "only"}}')
    none = F.lit('{"markdown": 5}')
    page = lambda k: F.element_at(F.array(blocks, lines, plain, none), ((d + k) % 4 + 1).cast("int"))
    made = normalize.pipeline_pages(rows.withColumn("raw", F.concat(F.lit("["), page(0), F.lit(", "), page(1), F.lit("]"))))
    return made.select("doc_id", "text", "markdown")


def variants_with_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parser variants behind a prefix; short texts are replaced, and each text as markdown."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.coalesce("lang", F.lit(""))).alias("text"))
    rows = normalize.variants(docs, prefix=" Draft ", replace_short=True)
    return rows.select("doc_id", "parser_name", "parsed_text", normalize.paragraph_markdown(F.col("parsed_text")).alias("markdown"))


def results_by_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three adapters, each normalized in its own way."""
    d = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select("doc_id", _pick(d % 4, "own", "other", "list", "gone").alias("adapter_key"), F.coalesce("source", F.lit("s")).alias("source"))
    own = F.concat(F.lit('{"text": "'), F.col("source"), F.lit('"}'))
    raw = F.when(d % 4 == 2, F.concat(F.lit('{"content_list": [{"type": "text", "page_idx": 0, "text": "'), F.col("source"), F.lit('"}]}'))).otherwise(own)
    made = normalize.by_adapter(rows.withColumn("raw", raw), {"own": "plain_text", "other": "plain_text", "list": "content_list"})
    blocks = F.flatten(F.transform("pages", lambda p: p["blocks"]))
    return made.select("doc_id", "adapter_key", "full_text", F.size(blocks).cast("long").alias("n_blocks"))


def truths_of_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truths with the file names of one owner's documents."""
    documents = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), F.col("c_name").alias("original_filename"), F.col("c_nationkey").cast("string").alias("owner_id"))
    truths = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("document_id"), F.col("o_orderkey").alias("truth_id"), F.col("o_orderdate").alias("updated_at"))
    return operations.with_documents(truths, documents, "7").select("truth_id", "document_id", "document_filename")


def preflight_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches, calls, output tokens and input characters that a study of documents with three questions each would take."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.lit("b").alias("block_id"), F.coalesce("text", F.lit("")).alias("text"))
    packed = retrieval.batches(retrieval.segments(rows, 1000), ["case_id"], ["segment_at"], 4000)
    questions = rows.select("case_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("question_id"))
    found = retrieval.preflight(rows.select("case_id").distinct(), packed, questions, 2, list(repair.CONDITIONS), (12_000, 1_200))
    return found.select("case_id", *[F.col(c).cast("long").alias(c) for c in ("batches", "questions", "input_characters", "calls", "max_output_tokens")])


def pairs_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns of each conversation as runs of an experiment, all of them and those with the first turn, by number and texts."""
    texts = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("experiment_id"), F.lpad(F.col("turn").cast("string"), 9, "0").alias("run_id"), F.col("text"))
    counted = lambda pairs, name: pairs.groupBy("experiment_id").agg(F.count("*").alias("n"), F.sum(F.length("base")).alias("base_chars")).withColumn("kind", F.lit(name))
    return counted(compare.run_pairs(texts), "all").unionByName(counted(compare.run_pairs(texts, "000000000"), "first"))


def questions_with_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on customers that have orders; other fields of questions stay behind."""
    questions = _table(spark, sf_dir, "customer").select(F.lit("c").alias("case_id"), F.col("c_name").alias("question_id"), F.col("c_custkey").cast("string").alias("document_id"), F.col("c_mktsegment").alias("question"), F.col("c_acctbal").alias("answer"))
    blocks = _table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").cast("string").alias("document_id"))
    return repair.matching_questions(questions, blocks)


def matches_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a registered list of rules, each on what the ones before it left."""
    masking.register_masker("orders", (("CODE", r"\d-[A-Z]+"), ("WORD", r"[A-Z]{2,}")))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", masking.match_counts(F.col("o_orderpriority"), "orders").alias("m"), masking.masked(F.col("o_orderpriority"), "orders").alias("masked"))
    return rows.select("o_orderkey", F.col("m")["CODE"].cast("long").alias("n_code"), F.col("m")["WORD"].cast("long").alias("n_word"), "masked")


def stages_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two stages of events as one trace, by stage and type."""
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), "event_type", "user_id")
    whole = operations.trace({"parse": events.select("run_id", "event_type"), "score": events.filter("user_id % 2 = 0").select("run_id", F.col("user_id").alias("user"))}, ["run_id"])
    return whole.select("run_id", F.col("stage_at").cast("long").alias("stage_at"), "stage", "row")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        file_catalog, outputs_of_folders, pages_of_results, artifact_rows, merged_configurations, percentiles_of_values, dataset_changes, changed_ranges, rebuilt_turns, span_places,
        masking_inputs, blocks_for_research, chosen_questions, grid_of_conditions, runs_of_connectors, upserted_scores, inputs_of_batches,
        runner_gate, execution_gate, pages_of_pipelines, variants_with_prefix, results_by_adapter, truths_of_owner,
        preflight_of_cases, pairs_of_runs, questions_with_blocks, matches_by_rule, stages_of_runs,
    )
}
