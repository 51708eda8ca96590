"""What changed in a table: a tree of hashes over ranges of keys, and the rows behind a difference.

Leaves are ranges of hashed keys, an inner node is all that lies below it.  A node's digest
doesn't depend on the order of rows and is summed up before the shuffle, so a tree of any
table costs one aggregation; it is small, can be stored, and is compared with a later one
without the older table.  With both tables at hand only rows of changed ranges are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 10
_PARTS = 8


def _row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row by name of column, whatever their order; null differs from empty."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def _leaf(keys: list[str], depth: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(1 << depth)).cast("int")


def _digest(sums: list[Column], n: Column) -> Column:
    return F.sha2(F.concat_ws(",", n.cast("string"), *[s.cast("string") for s in sums]), 256)


def hash_tree(rows: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """level (0: the whole table), node, n_rows, digest; ranges without rows have no node.

    Rows that repeat count as often as they occur.
    """
    h = _row_hash(rows.columns)
    parts = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(_PARTS)]
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(_PARTS)]
    leaves = rows.select(_leaf(keys, depth).alias("leaf"), *parts).groupBy("leaf").agg(F.count("*").alias("n_rows"), *sums)
    levels = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("node", F.call_function("shiftright", "leaf", F.lit(depth) - F.col("level")))
    nodes = levels.groupBy("level", "node").agg(F.sum("n_rows").alias("n_rows"), *sums)
    return nodes.select("level", "node", "n_rows", _digest([F.col(f"p{i}") for i in range(_PARTS)], F.col("n_rows")).alias("digest"))


def changed_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """level, node, rows_before, rows_after of the nodes of two trees that differ."""
    side = lambda tree, name: tree.select("level", "node", F.col("n_rows").alias(f"rows_{name}"), F.col("digest").alias(f"digest_{name}"))
    both = side(before, "before").join(side(after, "after").hint("shuffle_hash"), ["level", "node"], "full_outer")
    differ = both.filter(~F.col("digest_before").eqNullSafe(F.col("digest_after")))
    return differ.select("level", "node", F.coalesce("rows_before", F.lit(0)).alias("rows_before"), F.coalesce("rows_after", F.lit(0)).alias("rows_after"))


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str], changed: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """keys, change (added, removed, changed) of the keys whose rows differ between two tables.

    changed: changed_nodes() of their trees, of the same depth; what lies in other ranges isn't
    compared.  Rows that share a key are compared together.
    """
    if changed is None:
        changed = changed_nodes(hash_tree(before, keys, depth), hash_tree(after, keys, depth))
    # At most two to the power of depth ranges.
    leaves = F.broadcast(changed.filter(F.col("level") == depth).select(F.col("node").alias("_leaf")))

    def side(rows: DataFrame, name: str) -> DataFrame:
        hashed = rows.select(*keys, _leaf(keys, depth).alias("_leaf"), _row_hash(rows.columns).alias("_h")).join(leaves, "_leaf", "left_semi")
        parts = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(_PARTS)]
        return hashed.groupBy(*keys).agg(_digest(parts, F.count("*")).alias(f"_{name}"))

    # Keys are compared as one text, in which a null is a value.
    named = lambda df: df.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_k"), F.struct(*keys).alias("_key"), *[c for c in df.columns if c in ("_before", "_after")])
    both = named(side(before, "before")).join(named(side(after, "after")).withColumnRenamed("_key", "_other").hint("merge"), "_k", "full_outer")
    both = both.withColumn("_key", F.coalesce("_key", "_other")).select("_key.*", "_before", "_after")
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").when(F.col("_before") != F.col("_after"), "changed")
    return both.select(*keys, change.alias("change")).filter("change IS NOT NULL")
