"""Best-fit packing of tokenized documents into sequences of fixed capacity.

1. Documents are tokenized in place (``mapInPandas``, no shuffle of texts); only small
   piece rows leave this step.
2. Pieces are range-sorted by falling length.  Each task numbers its own pieces of a
   length, so a length that holds a third of all pieces spans many tasks; adding the
   counts of the tasks before gives each piece its rank among all pieces of its length.
3. Rounds match lengths, longest first, with gaps.  Pieces of one length are alike and
   so are gaps of one size, therefore a round works on counts: it sweeps the gap sizes
   upward from the successor of the length, fills each gap with as many pieces as it
   holds, opens new sequences for the rest, and moves the filled gaps to their new size.
   This is best-fit decreasing, as if the pieces were placed one by one.  There are at
   most ``capacity`` lengths and rounds, and a round splits at most one run of equal
   gaps into three, so the plan is bounded by the capacity, not by the corpus.
4. Conflicts are resolved by rank: the k-th piece of a length takes the k-th place that
   the plan has for it.  Each task looks its pieces up in the plan; no join is needed.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.stage import stored, whole_text

CAPACITY = 2048
#: Words that a Python worker keeps at most.
_WORDS_KEPT = 1_200_000
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the tokenizer
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of texts as little-endian bytes; words between white space are encoded once.

    For byte-level tokenizers that lower-case, drop white space, and join neither across it
    nor letters with what is none.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.ids: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.spelling = ByteLevel(add_prefix_space=False, use_regex=False)

    def _learn(self, words: list[str]) -> None:
        """Latin words are lower-cased and parted from the punctuation behind them, as the tokenizer does, so that fewer are new."""
        cut, whole = [], []
        for word in words:
            core = word.rstrip(".,!?;:")
            if core.isalpha() and max(core) < "\u0250" and "\u0130" not in core:
                cut.append((word, core.lower(), word[len(core) :]))
            else:
                whole.append(word)
        if len(self.parts) > _WORDS_KEPT:
            self.parts.clear()
        self._encode(whole, self.ids)
        parts, spelled, tokenize = self.parts, self.spelling.pre_tokenize_str, self.tokenizer.model.tokenize
        for part in {part for _, core, tail in cut for part in (core, tail) if part}.difference(parts):
            parts[part] = np.array([t.id for t in tokenize(spelled(part)[0][0])], "<u4").tobytes()
        self.ids.update((word, parts[core] + parts[tail] if tail else parts[core]) for word, core, tail in cut)

    def _encode(self, words: list[str], into: dict[str, bytes]) -> None:
        for at in range(0, len(words), 200):  # one call for many words, told apart by their word ids
            some = words[at : at + 200]
            encoded = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4").tobytes()
            ends = 4 * np.cumsum(np.bincount(np.array(encoded.word_ids, "int64"), minlength=len(some)))
            into.update(zip(some, map(ids.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))

    def encode(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split()
        if len(self.ids) > _WORDS_KEPT:
            self.ids.clear()
        if new := list(set(words).difference(self.ids)):
            self._learn(new)
        return b"".join(map(self.ids.__getitem__, words))


def _encoder(tokenizer_file: str) -> WordEncoder:
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = WordEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's tokens and end_id, cut at capacity."""

    def tokenized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end, step = _encoder(tokenizer_file), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"], strict=True):
                ids = encoder.encode(text) + end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInPandas(tokenized, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces a sequence, offset), for runs of sequences filled alike.

    counts: pieces by length.  A run ends where the next one of its length begins.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    sizes: list[int] = []  # sizes of which there are gaps, rising
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs (first sequence, sequences)
    opened = 0

    def add(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)  # the successor: the smallest gap that holds it
            if at == len(sizes):
                n = -(-left // (capacity // length))
                add(capacity, opened, n)
                opened += n
                continue
            size = sizes[at]
            first, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], sizes[at]
            each = size // length
            full, rest = (n, 0) if left >= n * each else divmod(left, each)
            if full:
                plan.append((length, rank, first, each, capacity - size))
                add(size - each * length, first, full)
            if rest:
                plan.append((length, rank + full * each, first + full, rest, capacity - size))
                add(size - rest * length, first + full, 1)
            add(size, first + full + bool(rest), n - full - bool(rest))
            rank += full * each + rest
            left -= full * each + rest
    return plan


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every piece of docs with its sequence_id and its offset there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty
    text is the single piece of end_id; a null doc_id stays null; repeated rows are packed
    as often as they occur; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_file, capacity, end_id), "pieces")

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before, seen = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            lengths = b["length"].to_numpy()
            if not len(lengths):
                continue
            starts = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]])
            rank = np.arange(len(lengths)) - np.repeat(starts, np.diff(np.r_[starts, len(lengths)]))
            if lengths[0] == before:
                rank[: starts[1] if len(starts) > 1 else None] += seen
            before, seen = lengths[-1], rank[-1] + 1
            yield b.assign(part=part, rank=rank)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("length"), "doc_id", "piece"]
    ordered = stored(cut.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(ranked, f"{cut.schema.simpleString()[7:-1]}, part long, rank long"), "ranked")

    # A row for each task, and one more for each length at most.
    held = sorted((r["length"], r["part"], r["n"]) for r in ordered.groupBy("length", "part").agg(F.count("*").alias("n")).collect())
    counts: dict[int, int] = {}
    bases = []
    for length, part, count in held:
        bases.append((part * (capacity + 1) + length, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + count
    bases.sort()
    plan = sorted(best_fit_plan(counts, capacity))
    known = spark.sparkContext.broadcast((np.array(bases, "int64").reshape(-1, 2), np.array(plan, "int64").reshape(-1, 5)))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, runs = known.value
        places = runs[:, 0] * 2**50 + runs[:, 1]
        for b in batches:
            length = b["length"].to_numpy()
            rank = b["rank"].to_numpy() + base[np.searchsorted(base[:, 0], b["part"].to_numpy() * (capacity + 1) + length), 1]
            _, first, sequence, each, offset = runs[np.searchsorted(places, length * 2**50 + rank, "right") - 1].T
            out = b[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence + (rank - first) // each, offset=offset + (rank - first) % each * length)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return ordered.mapInPandas(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
