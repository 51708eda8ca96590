"""Stupid-backoff language-model scores of all documents, by joins on hashed n-grams.

The model is counted over the whole corpus; every document is scored against all others
(its own occurrences are taken off each count), so a text that occurs nowhere else backs
off.  Score of a word after its history: c(history, word) / c(history) if that n-gram
occurs in another document, else ``alpha`` times the score with the history shortened by
its first word; the last resort is c(word) / N, and 1 / (N + 1) for a word that occurs in
no other document.

Rows are packed, because one row for each n-gram would be several times the input:

1. Documents are dealt to blocks of about ``BLOCK_BYTES`` by a hash of their id.  A block
   explodes its documents into n-grams, pre-aggregates them, and sends its different
   n-gram hashes with counts to the bucket (range of hashes) that they fall into.
2. A bucket adds the counts of all blocks: its part of the n-gram count table.  It
   answers every block with what the others have of the hashes that it sent, in their order.
3. Each block joins the answers with its exploded n-grams and sums per document.

Blocks and buckets grow in number with the input, not in size; hashing spreads frequent
n-grams evenly, since a block sends each only once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from docgauge.llm.stage import doc_key, id_from, stored, whole_text
from docgauge.llm.words import batch_codes, window_hashes

ORDER = 3
ALPHA = 0.4
BLOCK_BYTES = 8_000_000


def _packed(hashes: np.ndarray) -> bytes:
    """Rising hashes: the first whole, then differences in as many bytes each as the largest needs.

    The highest bytes are alike and stand together, Huffman-coded; the others are random.
    """
    steps = np.diff(hashes)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    coder = zlib.compressobj(6, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    top = coder.compress(planes[:, width - 1].tobytes()) + coder.flush()
    return struct.pack("<BQI", width, int(hashes[0]), len(top)) + top + planes[:, : width - 1].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width, first, n_top = struct.unpack_from("<BQI", data)
    at = struct.calcsize("<BQI")
    top = np.frombuffer(zlib.decompress(data[at : at + n_top], -15), np.uint8)
    steps = np.zeros((len(top), 8), np.uint8)
    steps[:, width - 1] = top
    steps[:, : width - 1] = np.frombuffer(data, np.uint8, offset=at + n_top).reshape(len(top), width - 1)
    return np.cumsum(np.r_[np.uint64(first), steps.view("<u8")[:, 0]], dtype=np.uint64)


def _ints(values: np.ndarray) -> bytes:
    """Counts, compressed byte plane by byte plane (nearly all are small)."""
    return zlib.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _from_ints(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8")[:, 0]


@F.pandas_udf(BinaryType())
def _squeezed(texts: pd.Series) -> pd.Series:
    """Texts as they travel to their blocks."""
    return texts.map(lambda t: zlib.compress(t.encode(), 1))


def _texts(squeezed: pd.Series) -> list[bytes]:
    return [zlib.decompress(t) for t in squeezed]


class Grams:
    """The n-grams of some documents, order by order."""

    def __init__(self, texts: list[bytes], order: int):
        flat, self.sizes = batch_codes([t.lower() for t in texts])
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.hashes, self.ends = [], []  # ends: the words with which the n-grams end
        for n in range(1, order + 1):
            ends = np.flatnonzero(self.place >= n - 1)
            self.ends.append(ends)
            self.hashes.append(window_hashes(flat, n)[ends - (n - 1)])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of hashes, so they rise with the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _asked(keyed: DataFrame, order: int, buckets: int) -> DataFrame:
    """block, n, bucket, hashes, counts: the different n-grams of each block."""

    def asked(pdf: pd.DataFrame) -> pd.DataFrame:
        grams, rows, block = Grams(_texts(pdf["text"]), order), [], int(pdf["block"].iloc[0])
        copies = pdf["copies"].to_numpy()
        for n, all_ in enumerate(grams.hashes, 1):
            hashes, counts = _counted(all_, copies[grams.doc[grams.ends[n - 1]]])
            if len(hashes):
                bucket = _bucket(hashes, buckets)
                cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(hashes)]
                rows += [(block, n, int(bucket[a]), _packed(hashes[a:b]), _ints(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame(rows, columns=["block", "n", "bucket", "hashes", "counts"])

    return keyed.select("block", "text", "copies").groupBy("block").applyInPandas(asked, "block long, n int, bucket long, hashes binary, counts binary")


def _answered(asked: DataFrame) -> DataFrame:
    """block, n, bucket, others, all: how often other blocks have what each block asked for; all: n-grams in the bucket's table."""

    def answered(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [_unpacked(h) for h in pdf["hashes"]]
        counts = np.concatenate([_from_ints(c) for c in pdf["counts"]])
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        others = np.bincount(inverse, weights=counts).astype(np.int64)[inverse] - counts
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        packed = [_ints(t) for t in np.split(others, cuts)]
        return pdf[["block", "n", "bucket"]].assign(others=packed, all=int(counts.sum()))

    return asked.groupBy("n", "bucket").applyInPandas(answered, "block long, n int, bucket long, others binary, all long")


def _counted(grams: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams, rising, and how often each occurs, a document counting once for each of its copies."""
    if (copies == 1).all():
        return np.unique(grams, return_counts=True)
    hashes, inverse = np.unique(grams, return_inverse=True)
    return hashes, np.bincount(inverse, weights=copies, minlength=len(hashes)).astype(np.int64)


def _own_counts(doc: np.ndarray, gram: np.ndarray, n_grams: int) -> np.ndarray:
    """How often each occurrence's n-gram occurs in its own document."""
    _, inverse, counts = np.unique(doc * n_grams + gram, return_inverse=True, return_counts=True)
    return counts[inverse]


def _scores(grams: Grams, copies: np.ndarray, elsewhere: list[np.ndarray], all_words: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log scores and number of words that backed off, per document; elsewhere: what other blocks have of each order's n-grams."""
    size, order = len(grams.doc), len(grams.hashes)
    others = np.zeros((order + 1, size), np.int64)  # [n, word]: occurrences elsewhere of the n-gram that ends there
    others[0] = all_words - grams.sizes[grams.doc]
    for n in range(1, order + 1):
        ends = grams.ends[n - 1]
        if len(ends):
            known, gram = np.unique(grams.hashes[n - 1], return_inverse=True)
            counts = np.bincount(gram, weights=copies[grams.doc[ends]], minlength=len(known)).astype(np.int64)
            others[n][ends] = (elsewhere[n - 1] + counts)[gram] - _own_counts(grams.doc[ends], gram, len(known))
    score, open_, backed = np.zeros(size), np.ones(size, bool), np.zeros(size, bool)
    for n in range(order, 0, -1):
        history = others[0] if n == 1 else np.r_[np.int64(0), others[n - 1][:-1]]
        seen = open_ & (grams.place >= n - 1) & (others[n] > 0)
        score[seen] += np.log(others[n][seen] / history[seen])
        open_ &= ~seen
        if n > 1:
            shorter = open_ & (grams.place >= n - 1)
            score[shorter] += log(alpha)
            backed |= shorter
    score[open_] -= np.log(others[0][open_] + 1)
    n_docs = len(grams.sizes)
    return np.bincount(grams.doc, score, n_docs), np.bincount(grams.doc, backed, n_docs).astype(np.int64)


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, log_score (sum over its words), mean_log_score (null without words), n_backed_off.

    Words are separated by space and the characters 9 to 13, A-Z lower-cased.  Null and empty
    texts have no words and log_score 0; very long texts are scored whole.  A null doc_id stays
    null; rows that share a doc_id are documents of their own, one row each.  Rows that repeat
    are counted first and travel as one row with its number of copies; each copy has the others
    as other documents.  An empty table gives no rows; other columns are ignored.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(size // block_bytes) + 1
    buckets = max(1, blocks // 2)
    text_hash = F.xxhash64(whole_text()).alias("text_hash")
    keyed = docs.select(doc_key().alias("_key"), text_hash, whole_text().alias("text"))
    same = ["_key", "text_hash"]
    repeated = stored(docs.select(doc_key().alias("_key"), text_hash).groupBy(*same).agg(F.count("*").alias("copies")).filter("copies > 1"), "repeated-rows")
    some = not repeated.isEmpty()
    if some:
        keyed = keyed.join(repeated.hint("shuffle_hash"), same, "left").dropDuplicates(same).withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    else:
        keyed = keyed.withColumn("copies", F.lit(1).cast("long"))
    keyed = keyed.withColumns({"block": F.pmod(F.xxhash64(*same), F.lit(blocks)), "text": _squeezed("text")}).drop("text_hash")
    totals = stored(_answered(_asked(keyed, order, buckets)), "ngram-totals")
    all_words = int(totals.filter("n = 1").select("bucket", "all").distinct().agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0])

    def scored(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        grams = Grams(_texts(pdf["text"]), order)
        answers = answers.sort_values(["n", "bucket"])
        counts = []
        for n in range(1, order + 1):
            parts = [_from_ints(t) for t in answers.loc[answers["n"] == n, "others"]]
            counts.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        total, backed = _scores(grams, pdf["copies"].to_numpy(), counts, all_words, alpha)
        return pd.DataFrame({"_key": pdf["_key"].to_numpy(), "n_words": grams.sizes, "log_score": total, "n_backed_off": backed, "copies": pdf["copies"].to_numpy()})

    def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(len(b)):
                left = int(b["copies"].iloc[at])
                while left:
                    n = min(left, 100_000)
                    yield b.iloc[np.full(n, at)]
                    left -= n

    made = keyed.groupBy("block").cogroup(totals.select("block", "n", "bucket", "others").groupBy("block"))
    made = made.applyInPandas(scored, "_key long, n_words long, log_score double, n_backed_off long, copies long")
    if some:
        made = stored(made, "scores")
        made = made.filter("copies = 1").union(made.filter("copies > 1").mapInPandas(copied, made.schema))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return made.select(id_from(), "n_words", "log_score", mean.alias("mean_log_score"), "n_backed_off")
