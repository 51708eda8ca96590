"""Removal of lines that an earlier document already holds.

Line keys are hashed (128 bits) and range-partitioned by (hash, document, position), so
that a line found in a third of all documents spans many tasks.  Each task streams its
sorted rows: the first document of a hash keeps its lines, later ones lose them.  Only a
hash that began in an earlier task is open; one boundary row for each task decides it.
What is lost travels as a compressed keep bitmap for each document, never as text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.stage import doc_key, free_name, stored, whole_text

MIN_CHARS = 10
_STRIPPED = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(_STRIPPED).lower()


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """high, low, doc, position of every line whose key has min_chars characters or more."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            digests, docs_, positions = [], [], []
            for doc, text in zip(b["_key"].tolist(), b["text"], strict=True):
                for at, line in enumerate(text.encode().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        docs_.append(doc)
                        positions.append(at)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"high": halves[:, 0], "low": halves[:, 1], "doc": np.array(docs_, "int64"), "position": np.array(positions, "int32")})

    return docs.select(doc_key().alias("_key"), whole_text().alias("text")).mapInPandas(hashed, "high long, low long, doc long, position int")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """doc, position of the lines that a smaller doc holds as well."""
    spark = lines.sparkSession
    order = ["high", "low", "doc", "position"]

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """kind 0: lost; 1: lost if the hash began in a task before; 2: this task's first hash with its first document, 3: the last one."""
        part = TaskContext.get().partitionId()
        hash_, first, opening, last = None, 0, True, None
        for b in batches:
            if not len(b):
                continue
            high, low, doc = (b[c].to_numpy() for c in order[:3])
            new = np.r_[hash_ != (high[0], low[0]), (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
            starts = np.flatnonzero(new)
            if hash_ is None:
                yield pd.DataFrame({"part": [part], "kind": 2, "high": high[0], "low": low[0], "doc": doc[0], "position": 0})
            firsts = np.r_[first, doc[starts]][np.cumsum(new)]
            in_opening = np.cumsum(new) <= (1 if hash_ is None else 0) if opening else np.zeros(len(doc), bool)
            kind = np.where(doc > firsts, 0, np.where(in_opening, 1, -1))
            opening = bool(in_opening[-1])
            hash_, first = (high[-1], low[-1]), firsts[-1]
            last = pd.DataFrame({"part": [part], "kind": 3, "high": high[-1], "low": low[-1], "doc": first, "position": 0})
            yield b.assign(part=part, kind=kind)[kind >= 0]
        if last is not None:
            yield last

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = stored(
        lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*order).mapInPandas(streamed, "part long, kind int, high long, low long, doc long, position int"),
        "lines-marked",
    )
    # Two rows for each task that had rows.
    lost_parts, carried = [], (None, 0)
    for r in sorted(marked.filter("kind >= 2").collect(), key=lambda r: (r["part"], r["kind"])):
        hash_ = (r["high"], r["low"])
        first = carried[1] if carried[0] == hash_ else r["doc"]
        if r["kind"] == 2 and first < r["doc"]:
            lost_parts.append((r["part"],))
        carried = (hash_, first)
    lost = marked.filter("kind = 0").select("doc", "position")
    if lost_parts:
        opened = spark.createDataFrame(lost_parts, "part long")
        lost = lost.union(marked.filter("kind = 1").join(opened.hint("shuffle_hash"), "part").select("doc", "position"))
    return lost


def keep_bitmaps(lost: DataFrame) -> DataFrame:
    """_key, keep: a compressed bitmap up to the last lost line (1: kept); lines behind it are kept."""

    @F.pandas_udf("binary")
    def bitmap(positions: pd.Series) -> pd.Series:
        def one(at: np.ndarray) -> bytes:
            bits = np.ones(int(max(at)) // 8 * 8 + 8, np.uint8)
            bits[np.asarray(at)] = 0
            return zlib.compress(np.packbits(bits).tobytes())

        return positions.map(one)

    return lost.groupBy(F.col("doc").alias("_key")).agg(F.collect_set("position").alias("at")).select("_key", bitmap("at").alias("keep"))


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with lines removed that a document of smaller doc_id holds too.

    Returns the columns of docs (text: what is kept) and n_lines, n_dropped, keep.  Lines
    are split at \\n; a line's key is the line without white space at its ends and with
    A-Z lower-cased; keys under min_chars characters always stay.  A null or empty text is
    one empty line and gives an empty text; very long texts are taken whole; an empty table
    gives no rows.  A null doc_id counts as one document before
    all others; rows that share a doc_id count as one document, of which every row keeps
    what it is the first to hold (where such rows differ in text, their marks are pooled).
    Columns named n_lines, n_dropped or keep are replaced, others stay.
    """
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "keep")]
    key, bits_name, made_name = (free_name(docs.columns, c) for c in ("_key", "_keep", "_made"))
    bitmaps = keep_bitmaps(repeated_lines(stored(line_hashes(docs, min_chars), "lines"))).withColumnsRenamed({"_key": key, "keep": bits_name})
    joined = docs.select(*[f"`{c}`" for c in own], doc_key().alias(key)).join(bitmaps.hint("shuffle_hash"), key, "left")

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def kept(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k in zip(text, keep, strict=True):
            lines = t.split("\n")
            n = len(lines)
            if k is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8))[:n]
                lines = [x for x, bit in zip(lines, bits, strict=False) if bit] + lines[len(bits) :]
            rows.append(("\n".join(lines), n, n - len(lines)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    made = joined.withColumn(made_name, kept(whole_text(), F.col(bits_name)))
    return made.select(*[F.col(f"{made_name}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in own], *[F.col(f"{made_name}.{c}").alias(c) for c in ("n_lines", "n_dropped")], F.col(bits_name).alias("keep"))
