"""Importance resampling towards a target corpus, by bit-sliced counts.

Words are hashed into buckets; a bucket's gain is the scaled logarithm of its share in the
target against its share in the corpus, and a document's weight is the mean gain of its
features.  All sums are of whole numbers and exact:

1. A document's bucket counts become planes of ``BUCKETS`` bits: plane p holds bit p of every
   count.  Texts are split once; the planes are written.
2. The corpus counts are the planes' column sums times their powers of two.
3. Gains become planes as well, those of gains above zero apart from those below.  The sum of
   gains of a document is the sum of 2^(p+q) popcount(plane p AND gain plane q), signed.

A Gumbel draw from a keyed hash of the doc_id is added to the weight; the highest scores are
drawn.  Scores are whole numbers within a bound that the corpus can't move (about 10^5
different ones), so counts by score tell where the draw ends; what is drawn is range-sorted,
and ranks are places within a range plus the rows of the ranges before it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.llm.stage import stored, whole_text

BUCKETS = 10_000
#: Texts are split in stretches of about this many bytes.
_STRETCH = 1 << 20
#: Documents that are handled at a time.
_DOCS = 500
_NUMBERS = ["doc_id", "n_words", "n_features"]
#: Maps A-Z to a-z, keeps letters, digits and all of non-ASCII characters, and makes a space of the rest.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low in range(0, len(b), _DOCS):
            yield b.slice(low, _DOCS)


def _stretches(folded: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(folded):
        cut = folded.find(b" ", at + _STRETCH)
        cut = len(folded) if cut < 0 else cut
        yield folded[at:cut].split()
        at = cut


def bucket_counts(text: str, run: int = 1, buckets: int = BUCKETS) -> tuple[int, Counter[int]]:
    """The number of words, and the features of each bucket: runs of 1 to ``run`` words joined by a space."""
    words, features, before = 0, Counter(), []
    for part in _stretches(text.encode("utf-8", "surrogatepass").translate(_FOLD)):
        words += len(part)
        features.update(part)
        part = before + part
        for n in range(2, run + 1):  # runs that end in this stretch
            first = max(0, len(before) - n + 1)
            features.update(b" ".join(part[i : i + n]) for i in range(first, len(part) - n + 1))
        before = part[max(0, len(part) - run + 1) :] if run > 1 else []
    found: Counter[int] = Counter()
    for feature, n in features.items():
        found[zlib.crc32(feature) % buckets] += n
    return words, found


def _width(buckets: int) -> int:
    """Bytes of a plane, whole 64-bit words."""
    return 8 * -(-buckets // 64)


def _planes(counts: Counter[int], buckets: int) -> bytes:
    if not counts:
        return b""
    at, n = np.fromiter(counts.keys(), "int64", len(counts)), np.fromiter(counts.values(), "int64", len(counts))
    bits = np.zeros((int(n.max()).bit_length(), 8 * _width(buckets)), bool)
    for p, row in enumerate(bits):
        row[at] = n >> p & 1
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


def document_planes(docs: DataFrame, run: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, planes of every document."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            words, features, planes = [], [], []
            for text in b.column("text"):
                n, counts = bucket_counts(text.as_py(), run, buckets)
                words.append(n)
                features.append(counts.total())
                planes.append(_planes(counts, buckets))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(planes, pa.binary())], ["doc_id", "n_words", "n_features", "planes"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(sliced, "doc_id long, n_words long, n_features long, planes binary")


def _stacked(planes: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All planes as rows of 64-bit words, the document and the power of two of each row."""
    width = _width(buckets)
    depth = pc.binary_length(planes).to_numpy(zero_copy_only=False).astype("int64") // width
    rows = np.frombuffer(b"".join(planes.to_pylist()), "<u8").reshape(-1, width // 8)
    owner = np.repeat(np.arange(len(planes)), depth)
    return rows, owner, np.arange(len(rows)) - np.repeat(np.cumsum(depth) - depth, depth)


def corpus_counts(planes: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all documents by bucket; at most a row for each task and bucket is shuffled."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(8 * _width(buckets), "int64")
        for b in _parts(batches):
            rows, _, power = _stacked(b.column("planes"), buckets)
            for p in np.unique(power):
                total += np.unpackbits(rows[power == p].view("u1"), axis=1, bitorder="little").sum(0, dtype="int64") << int(p)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = np.zeros(buckets, "int64")
    found = planes.select("planes").mapInArrow(summed, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in found.collect():  # a row for each bucket at most
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) for every bucket."""
    s_all, t_all, size = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], "int64")


def _gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane as 64-bit words) of gains."""
    out = []
    for sign in (1, -1):
        size = np.maximum(sign * gain, 0)
        for q in range(int(size.max(initial=0)).bit_length()):
            bits = np.zeros(8 * _width(len(gain)), bool)
            bits[: len(gain)] = size >> q & 1
            out.append((sign << q, np.packbits(bits, bitorder="little").view("<u8")))
    return out


def weights(planes: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of each document's features, 0 without any."""
    known, buckets = planes.sparkSession.sparkContext.broadcast(_gain_planes(gain)), len(gain)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            rows, owner, power = _stacked(b.column("planes"), buckets)
            each = np.zeros(len(rows), "int64")
            for value, plane in known.value:
                each += value * np.bitwise_count(rows & plane).sum(1, dtype="int64")
            total = np.zeros(len(b), "int64")
            np.add.at(total, owner, each << power)
            weight = total // np.maximum(b.column("n_features").to_numpy(), 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _NUMBERS), pa.array(weight)], [*_NUMBERS, "weight"])

    return planes.select(*_NUMBERS, "planes").mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int = 2024) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from a hash of seed and doc_id; a null doc_id counts as the word null."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank 1, 2, 3... in the given order; no task takes more than its range."""
    spark = rows.sparkSession

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            places = np.arange(seen + 1, seen + len(b) + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, "int32")), pa.array(places)], [*b.schema.names, "part", "place"])
            seen += len(b)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(numbered, f"{rows.schema.simpleString()[7:-1]}, part int, place long"), "resample-order")
    sizes = dict(ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each task
    before, at = {}, 0
    for part in sorted(sizes):
        before[part] = at
        at += sizes[part]
    offsets = spark.createDataFrame(list(before.items()), "part int, before long")
    return ordered.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")


def resampled(docs: DataFrame, target: DataFrame, run: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null unless it is drawn.

    target: a table with a column text.  Of the documents with ``least_words`` words or more,
    ``percent`` in a hundred are drawn, highest scores first, ties to the smaller doc_id (null
    after all others), then to more features, then to the greater weight; rows that are alike
    even so are interchangeable.  Null and empty texts have no features and weight 0; very
    long ones are split in stretches and counted whole; rows that repeat are documents of
    their own; an empty table gives no rows; an empty target makes all shares alike; other
    columns are ignored.
    """
    spark = docs.sparkSession
    planes = stored(document_planes(docs, run, buckets), "resample-planes")
    aims = stored(document_planes(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), run, buckets), "resample-target")
    gain = gains(corpus_counts(planes, buckets), corpus_counts(aims, buckets))
    scored = stored(weights(planes, gain).withColumn("score", F.col("weight") + gumbel(seed)), "resample-scores")
    able = F.col("n_words") >= least_words
    # A row for each whole score between the least and the greatest possible one.
    counts = scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    draws, seen, least = sum(r["n"] for r in counts) * percent // 100, 0, None
    for r in counts:
        if seen >= draws:
            break
        seen, least = seen + r["n"], r["score"]
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = F.coalesce(able & (F.col("score") >= least), F.lit(False))
    # Where a row lies in the written table deals out rows that are alike.
    tie = F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("tie")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight"), F.col("tie")]
    drawn = _ranked(scored.filter(near).select(*columns, tie), order).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return scored.filter(~near).select(*columns, F.lit(None).cast("long").alias("rank")).union(drawn.select(*columns, "rank"))
