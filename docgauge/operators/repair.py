"""Paired-repair studies: edited blocks, their inverse, and what answers recover or lose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions.columns import stable_id

#: Conditions and the repairs that each applies.
CONDITIONS = {"baseline": (), "no_op": (), "A": ("A",), "B": ("B",), "AB": ("A", "B")}
SAFE_BLOCK_FIELDS = ("case_id", "block_id", "document_id", "page_number", "text")
SAFE_QUESTION_FIELDS = ("case_id", "question_id", "document_id", "question")


def edited(text: Column, repairs: Column) -> Column:
    """text with repairs (array of start, end, after on the original places) applied from right to left."""
    last_first = F.array_sort(repairs, lambda a, b: F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).otherwise(0))
    return F.aggregate(last_first, text, lambda t, r: F.concat(F.left(t, r["start"]), r["after"], F.substring(t, r["end"] + 1, F.length(t))))


def conditions_grid(cases: DataFrame, repeats: int, conditions: list[str] | None = None) -> DataFrame:
    """case_id, repeat_id, condition, and place: a reproducible shuffled order of the conditions of a repeat."""
    names = conditions or list(CONDITIONS)
    grid = cases.select("case_id").distinct().select("case_id", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat_id"), F.array(*map(F.lit, names)).alias("names"))
    mixed = F.array_sort(F.transform("names", lambda n: F.struct(F.sha2(F.concat_ws(":", F.col("case_id"), F.col("repeat_id").cast("string"), n), 256).alias("h"), n.alias("condition"))))
    return grid.select("case_id", "repeat_id", F.posexplode(mixed).alias("place", "m")).select("case_id", "repeat_id", "place", "m.condition")


def repaired_blocks(blocks: DataFrame, repairs: DataFrame, conditions: list[str] | None = None) -> DataFrame:
    """Blocks of every condition with its repairs applied; only the safe fields leave."""
    names = conditions or list(CONDITIONS)
    selected = F.create_map(*[x for n in names for x in (F.lit(n), F.array(*map(F.lit, CONDITIONS[n])).cast("array<string>"))])
    by_block = repairs.groupBy("case_id", "block_id").agg(F.collect_list(F.struct("candidate_id", "start", "end", "after")).alias("repairs"))
    rows = blocks.select(*SAFE_BLOCK_FIELDS).join(by_block.hint("merge"), ["case_id", "block_id"], "left").withColumn("condition", F.explode(F.array(*map(F.lit, names))))
    own = F.filter("repairs", lambda r: F.array_contains(F.element_at(selected, F.col("condition")), r["candidate_id"]))
    text = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, edited(F.col("text"), own)).otherwise(F.col("text"))
    return rows.withColumn("text", text).select("condition", *SAFE_BLOCK_FIELDS)


def safe_questions(questions: DataFrame) -> DataFrame:
    """Questions without anything that tells their answer."""
    return questions.select(*SAFE_QUESTION_FIELDS)


def inverse_repairs(repairs: DataFrame) -> DataFrame:
    """Repairs that undo repairs on the text with all of them applied: shifted places, before and after swapped."""
    grown = F.length("after") - F.length("before")
    others = repairs.select("case_id", "block_id", F.col("end").alias("o_end"), grown.alias("grown"))
    own = repairs.join(others.hint("merge"), ["case_id", "block_id"]).groupBy(*repairs.columns).agg(F.sum(F.when(F.col("o_end") <= F.col("start"), F.col("grown")).otherwise(0)).cast("int").alias("shift"))
    start = F.col("start") + F.col("shift")
    swapped = {"before": F.col("after"), "after": F.col("before"), "start": start, "end": start + F.length("after")}
    return own.select(*[swapped[c].alias(c) if c in swapped else F.col(c) for c in repairs.columns])


def injected(blocks: DataFrame, repairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with all repairs taken as corruptions, and the repairs that restore them."""
    by_block = repairs.groupBy("case_id", "block_id").agg(F.collect_list(F.struct("start", "end", "after")).alias("repairs"))
    rows = blocks.join(by_block.hint("merge"), ["case_id", "block_id"], "left")
    return rows.withColumn("text", F.when(F.col("repairs").isNotNull(), edited(F.col("text"), F.col("repairs"))).otherwise(F.col("text"))).drop("repairs"), inverse_repairs(repairs)


def unique_span(text: Column, needle: Column) -> Column:
    """Place (from 0) of needle where it occurs exactly once, else null."""
    n = (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)
    return F.when((F.length(needle) > 0) & (n == 1), F.instr(text, needle) - 1)


def case_of(blocks: DataFrame, questions: DataFrame, repairs: DataFrame, document_id: str, case_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks and questions of one document under a case, with the repairs."""
    own = lambda df: df.filter(F.col("document_id") == document_id).withColumn("case_id", F.lit(case_id))
    return own(blocks), own(questions), repairs.withColumn("case_id", F.lit(case_id))


def blind_sheet(records: DataFrame, gold: DataFrame) -> DataFrame:
    """Answers to judge with the reference, in order of judgment_id; nothing tells the condition.

    records: execution_id, question_id, answer, ...
    """
    id_ = stable_id(F.col("execution_id"), F.col("question_id"))
    return records.withColumn("judgment_id", id_).join(gold.select("question_id", "reference_answer").hint("merge"), "question_id").select("judgment_id", "question_id", "answer", "reference_answer").orderBy("judgment_id")


def judged(records: DataFrame, judgments: DataFrame) -> DataFrame:
    """Records (case_id, repeat_id, condition, execution_id, question_id) with the verdict of their judgment (judgment_id, correct).

    Records without a judgment are left out; gates.judgment_violations tells them.
    """
    keyed = records.withColumn("judgment_id", stable_id(F.col("execution_id"), F.col("question_id")))
    return keyed.join(judgments.select("judgment_id", "correct").hint("shuffle_hash"), "judgment_id").select("case_id", "repeat_id", "condition", "question_id", "correct")


def outcomes(judged: DataFrame) -> DataFrame:
    """Per case, repeat and condition: correct answers, accuracy, recovered and regressed questions, net recovery.

    judged: case_id, repeat_id, condition, question_id, correct.
    """
    keys = ["case_id", "repeat_id", "question_id"]
    base = judged.filter("condition = 'baseline'").select(*keys, F.col("correct").alias("base"))
    rows = judged.join(base.hint("merge"), keys)
    recovered, regressed = F.col("correct") & ~F.col("base"), ~F.col("correct") & F.col("base")
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("question_id"))))
    return rows.groupBy("case_id", "repeat_id", "condition").agg(
        F.count_if("correct").alias("correct_count"),
        F.count("*").alias("question_count"),
        (F.count_if("correct") / F.count("*")).alias("accuracy"),
        ids(recovered).alias("recovered_question_ids"),
        ids(regressed).alias("regressed_question_ids"),
        (F.count_if(recovered) - F.count_if(regressed)).alias("net_recovery"),
    )


def interactions(scored: DataFrame) -> DataFrame:
    """case_id, repeat_id, interaction_count (gain of both repairs beyond the sum of each) and no_op_net_change."""
    gains = scored.groupBy("case_id", "repeat_id").pivot("condition", list(CONDITIONS)).agg(F.first("net_recovery"))
    return gains.select("case_id", "repeat_id", (F.col("AB") - F.col("A") - F.col("B")).alias("interaction_count"), F.col("no_op").alias("no_op_net_change"))


def matching_questions(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Questions on documents that have blocks; only the safe fields leave."""
    return safe_questions(questions).join(blocks.select("document_id").distinct().hint("merge"), "document_id", "left_semi").select(*SAFE_QUESTION_FIELDS)
