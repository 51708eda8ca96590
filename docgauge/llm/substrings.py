"""Removal of word sequences that occur earlier in the corpus, by suffix trees in prefix partitions.

A window of ``length`` words is repeated if the same words start earlier.  Such windows are
the leaves below the internal nodes of depth ``length`` and more of the corpus' suffix tree;
maximal repeats are the runs of successive leaves of a document.

1. Every suffix of at least ``length`` words has a path: hashes of its first 1, 2, 4, 8 and
   ``length`` words, one behind the other in 96 bits.  Suffixes in order of their paths lie in
   order of their prefixes, and the leading bits that neighbours share tell how long a prefix
   they share.
2. Prefixes are measured: all suffixes are counted by the leading bits of their paths, and a
   prefix with more than ``group`` suffixes is lengthened and counted again, until each fits.
   Successive prefixes share a group up to that size.  So a frequent word is split by what
   follows it, rare ones are put together, and a task holds one group, whatever the corpus.
3. Suffixes are dealt to their groups.  A group sorts its paths, which is its suffix array; runs
   of equal whole paths are its internal nodes of full depth.  The earliest leaf of a node
   stays, all others are repeats.  Each slice of the input (``SLICE_BYTES``) does this for
   itself first and sends one suffix for each path, so a passage found in a third of all
   documents is sent once by each slice only (17 million times for 100 TB, 24 bytes each).
4. Repeats are dealt back to their documents and put together to runs.

Places travel packed: a slice gives one row for each group for which it has suffixes, so rows
never outnumber suffixes (they come near them from some hundred TB on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.llm.stage import doc_key, free_name, stored, whole_text
from docgauge.llm.words import batch_codes, mixed, window_hashes

LENGTH = 20
#: Suffixes that a task holds at once, twice as many at most (24 bytes each, and as much again to sort them).
GROUP = 1_500_000
#: Prefix lengths in words before the whole window, and their bits in a path; the window has the rest.
PREFIXES = ((1, 10), (2, 8), (4, 8), (8, 8))
FIRST_BITS, MORE_BITS = 16, 12
#: Texts that a task turns into suffixes at once.
SLICE_BYTES = 6_000_000


def paths(codes: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path (64 bits and 32 more), row and first word of every suffix with length words or more; codes: of the words of all rows, sizes: words of each."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(first + length <= sizes[row]) if len(codes) else row
    path, left = np.zeros(len(at), np.uint64), 64
    for words, bits in PREFIXES:
        if words < length:
            left -= bits
            path |= (window_hashes(codes, words)[at] >> np.uint64(64 - bits)) << np.uint64(left)
    window = window_hashes(codes, length)[at]
    path |= window >> np.uint64(64 - left)
    return path, (mixed(window) >> np.uint64(32)).astype(np.uint32), row[at], first[at]


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Keys and texts of an input in slices of about SLICE_BYTES, whatever the size of Arrow batches."""
    for b in batches:
        keys, texts, low, size = b["_key"].to_numpy(), [t.encode() for t in b["text"]], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > SLICE_BYTES or i + 1 == len(texts):
                yield keys[low : i + 1], texts[low : i + 1]
                low, size = i + 1, 0


def _slice_paths(keys: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path and its tail, document and first word of the suffixes of a slice in order of all these, and which is the first of its path."""
    path, tail, row, first = paths(*batch_codes(texts), length)
    doc = keys[row]
    order = _ordered(path, tail, doc, first)
    path, tail, doc, first = path[order], tail[order], doc[order], first[order]
    return path, tail, doc, first, np.r_[True, (path[1:] != path[:-1]) | (tail[1:] != tail[:-1])][: len(path)]


def _ordered(path: np.ndarray, tail: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The order by all four; only where paths repeat is more than the path looked at."""
    order = np.argsort(path)
    same = path[order][1:] == path[order][:-1]
    some = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    at = order[some]
    order[some] = at[np.lexsort((first[at], doc[at], tail[at], path[at]))]
    return order


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(doc_key().alias("_key"), whole_text().alias("text"))


def _measured(docs: DataFrame, length: int, bits: int, open_: np.ndarray | None, before: int) -> DataFrame:
    """prefix (leading bits of paths), n: rows that it will have; below the prefixes open_ (of before bits) only, if given."""
    known = docs.sparkSession.sparkContext.broadcast(open_)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parents, held = known.value, []
        for keys, texts in _slices(batches):
            path, *_, new = _slice_paths(keys, texts, length)
            path = path[new]
            if parents is not None:
                path = path[np.isin(path >> np.uint64(64 - before), parents)]
            value, n = np.unique(path >> np.uint64(64 - bits), return_counts=True)
            held.append(pd.DataFrame({"prefix": value.view(np.int64), "n": n}))
            if sum(map(len, held)) > 1 << 20:
                yield pd.concat(held)
                held = []
        yield from held

    return _keyed(docs).mapInPandas(made, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))


def group_bounds(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> list[int]:
    """The least path of each group of suffixes, rising.

    A group has less than twice group rows, but for a single path that has more.  What the
    driver holds is about one entry for every group rows.
    """
    found: list[tuple[int, int]] = []  # least path, rows
    open_, bits, before = None, FIRST_BITS, 0
    while True:
        counts = stored(_measured(docs, length, bits, open_, before), "prefixes")
        # Runs of successive prefixes are put together below their common beginning; they end at prefixes that are too large.
        parent = F.shiftrightunsigned("prefix", 8 if open_ is None else bits - before)
        earlier = Window.partitionBy("parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        numbered = counts.withColumn("parent", parent).withColumn("run", F.floor(F.coalesce(F.sum(F.least("n", F.lit(group))).over(earlier), F.lit(0)) / group))
        runs = numbered.filter(F.col("n") <= group).groupBy("parent", "run").agg(F.min("prefix").alias("prefix"), F.sum("n").alias("n"))
        least = lambda prefix, bits=bits: (prefix % 2**64) << (64 - bits)
        found += [(least(r["prefix"]), r["n"]) for r in runs.collect()]
        over = counts.filter(F.col("n") > group).collect()
        if bits == 64:  # single paths, one suffix for each slice
            found += [(least(r["prefix"]), r["n"]) for r in over]
        if bits == 64 or not over:
            break
        open_, before, bits = np.array([r["prefix"] for r in over], np.int64).view(np.uint64), bits, min(bits + MORE_BITS, 64)
    bounds: list[int] = []
    rows = group
    for path, n in sorted(found):
        if rows + n > group:
            bounds.append(path)
            rows = 0
        rows += n
    return bounds


def _packed(doc: np.ndarray, first: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places by document: documents with their numbers of places, and first words as low and high halves."""
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
    docs = np.stack([doc[start], np.diff(np.r_[start, len(doc)])]).astype("<i8")
    return docs.tobytes(), (first & 0xFFFF).astype("<u2").tobytes(), (first >> 16).astype("<u2").tobytes()


def _unpacked(docs: bytes, low: bytes, high: bytes) -> tuple[np.ndarray, np.ndarray]:
    doc, n = np.frombuffer(docs, "<i8").reshape(2, -1)
    return np.repeat(doc, n), np.frombuffer(low, "<u2").astype(np.int64) | np.frombuffer(high, "<u2").astype(np.int64) << 16


#: task: a group's, or that of the documents that rows of repeats are dealt back to (path empty).
_DEALT = "task int, path binary, tail binary, docs binary, low binary, high binary, more binary"


def _returned(doc: np.ndarray, first: np.ndarray, tasks: int) -> list[tuple]:
    """Rows of repeated windows, by the tasks of their documents."""
    doc, first, more = windows_as_runs(doc, first)
    task = (mixed(doc.view(np.uint64)) % np.uint64(tasks)).astype(np.int64)
    order = np.argsort(task, kind="stable")
    task, doc, first, more = task[order], doc[order], first[order], more[order]
    cuts = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True]) if len(task) else []
    return [(int(task[a]), b"", b"", *_packed(doc[a:b], first[a:b]), more[a:b].astype("<i4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["task", "path", "tail", "docs", "low", "high", "more"])


def _suffixes(docs: DataFrame, length: int, bounds: list[int]) -> DataFrame:
    """Suffixes for their groups, and what each slice has found to be repeats."""
    known = docs.sparkSession.sparkContext.broadcast(np.array(bounds, np.uint64))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = known.value
        for keys, texts in _slices(batches):
            path, tail, doc, first, new = _slice_paths(keys, texts, length)
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = ~new & ((doc != doc[head]) | (first != first[head]))  # rows that repeat are one document
            rows = _returned(doc[later], first[later], len(least))
            path, tail, doc, first = path[new], tail[new], doc[new], first[new]
            task = np.searchsorted(least, path, "right") - 1  # rises with paths
            cuts = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True]) if len(task) else []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                some = low + np.lexsort((first[low:high], doc[low:high]))
                rows.append((int(task[low]), path[some].astype("<u8").tobytes(), tail[some].astype("<u4").tobytes(), *_packed(doc[some], first[some]), b""))
            yield _frame(rows)

    return _keyed(docs).mapInPandas(made, _DEALT)


def windows_as_runs(doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, first, more (further windows) of the runs of successive windows, each window once."""
    order = np.lexsort((first, doc))
    doc, first = doc[order], first[order]
    once = np.r_[True, (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])][: len(doc)]
    doc, first = doc[once], first[once]
    start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1)][: len(doc)])
    return doc[start], first[start], np.diff(np.r_[start, len(doc)]) - 1


def later_leaves(path: np.ndarray, tail: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The suffixes below internal nodes of full depth (whose whole path stands twice), but for the earliest of each node."""
    order = _ordered(path, tail, doc, first)
    same = (path[order][1:] == path[order][:-1]) & (tail[order][1:] == tail[order][:-1])
    head = np.maximum.accumulate(np.where(np.r_[True, ~same][: len(order)], np.arange(len(order)), 0))
    leaf, head = order, order[head]
    return leaf[(doc[leaf] != doc[head]) | (first[leaf] != first[head])]


def repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc, ends: first and last window (one behind the other) of each run of windows whose words start earlier too."""
    bounds = group_bounds(docs, length, group)
    schema = "doc long, ends array<int>"
    if not bounds:
        return docs.sparkSession.createDataFrame([], schema)
    tasks = len(bounds)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for b in batches:
            done = (b["path"].str.len() == 0).to_numpy()
            yield b[done]
            for path, tail, *places in zip(*(b.loc[~done, c] for c in ("path", "tail", "docs", "low", "high")), strict=True):
                held.append((np.frombuffer(path, "<u8"), np.frombuffer(tail, "<u4"), *_unpacked(*places)))
        if held:
            path, tail, doc, first = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            later = later_leaves(path, tail, doc, first)
            yield _frame(_returned(doc[later], first[later], tasks))

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for b in batches:
            for more, *places in zip(*(b[c] for c in ("more", "docs", "low", "high")), strict=True):
                held.append((*_unpacked(*places), np.frombuffer(more, "<i4").astype(np.int64)))
        if not held:
            return
        doc, first, more = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((first, doc))
        doc, first, last = doc[order], first[order], (first + more)[order]
        ends = np.stack([first, last], 1).astype(np.int32).ravel()
        cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
        for at in range(0, len(cuts) - 1, 1000):
            some = cuts[at : at + 1001].tolist()
            yield pd.DataFrame({"doc": doc[some[:-1]], "ends": [ends[2 * a : 2 * b] for a, b in zip(some[:-1], some[1:], strict=True)]})

    dealt = _suffixes(docs, length, bounds).repartitionById(tasks, "task")
    return dealt.mapInPandas(compared, _DEALT).repartitionById(tasks, "task").mapInPandas(gathered, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """docs without words covered by a window of length words that also starts earlier.

    Earlier: in a document of smaller doc_id, or before in the same one; windows are judged
    on the input.  Words are separated by space and the characters 9 to 13.  Returns the columns of
    docs (text: the kept words, joined by one space), n_words, n_removed and removed
    (array of from, to: word positions, to exclusive).  Null and empty texts have no words;
    very long texts are taken whole.  A null doc_id counts as one document before all
    others; rows that share a doc_id count as one document, of which every row is returned
    (where such rows differ in text, their marks are pooled).  An empty table gives no rows.
    Columns named n_words, n_removed or removed are replaced, others stay.
    """
    own = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "removed")]
    key, marked, made_name = (free_name(docs.columns, c) for c in ("_key", "_marks", "_made"))

    marks = stored(repeats(docs, length, group).select(F.col("doc").alias(key), F.col("ends").alias(marked)), "marks")
    joined = docs.select(*[f"`{c}`" for c in own], doc_key().alias(key)).join(marks.hint("shuffle_hash"), key, "left")

    @F.pandas_udf("text string, n_words long, n_removed long, removed array<struct<`from`: long, `to`: long>>")
    def kept(text: pd.Series, marks_: pd.Series) -> pd.DataFrame:
        rows = []
        for t, ends in zip(text, marks_, strict=True):
            words = t.encode().split()
            n, spans = len(words), []
            if ends is not None and n:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.minimum(ends[::2], n), 1)
                np.add.at(edge, np.minimum(ends[1::2] + length, n), -1)
                gone = np.r_[False, np.cumsum(edge)[:n] > 0, False]
                turns = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
                spans = [{"from": a, "to": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                keep = [0, *turns, n]
                words = [w for a, b in zip(keep[::2], keep[1::2], strict=True) for w in words[a:b]]
            rows.append((b" ".join(words).decode(), n, n - len(words), spans))
        return pd.DataFrame(rows, columns=["text", "n_words", "n_removed", "removed"])

    made = joined.withColumn(made_name, kept(whole_text(), F.col(f"`{marked}`")))
    return made.select(*[F.col(f"`{made_name}`.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in own], *[F.col(f"`{made_name}`.{c}").alias(c) for c in ("n_words", "n_removed", "removed")])
