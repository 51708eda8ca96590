"""Benchmark items inside documents, also with other numbers, names and units.

Texts become templates: words in lower case without punctuation at their ends, where
numbers, names (capitalised words that don't open a sentence) and units (after a number)
are replaced by typed placeholders.  Windows of five template words are hashed and
hash-joined with those of the benchmark.  Windows of which fewer than ``MIN_PLAIN`` words are
plain say too little and are left out.

Beside its template every item has a literal form, the same words without placeholders, whose
windows are all used.  So items that are mostly numbers and names, and copies in other case,
are found word for word.  An item of fewer than five words is one literal window as a whole;
such a match is told apart (form ``short``), as it says little: the stage takes it for a leak
only where the item is all of a line.

A document holds an item if, in one form, windows on nearby alignments (places in the document
less places in the item, within a fifth of the item) make up 0.8 of the item's different
windows.  Windows count only if their slots are filled consistently over these alignments:
values of the item and of the document go together one to one, those first that meet most
often, and windows that say otherwise are dropped.

Only windows that occur in the benchmark leave the document scan: while the benchmark
has at most ``BROADCAST_WINDOWS`` windows (8 bytes each) their hashes are broadcast as a
filter; a larger benchmark is joined without it, by the same shuffled join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.stage import doc_key, free_name, id_from, stored, whole_text
from docgauge.llm.words import mixed, window_hashes

WINDOW = 5
MIN_SHARE = 0.8
MIN_PLAIN = 3  # words of a window that are no placeholders
BROADCAST_WINDOWS = 1_000_000

#: Units that are replaced after a number.
UNITS = frozenset(
    """
    mm cm m km inch inches in ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds oz
    ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month
    months year years mph kmh kph percent % dollar dollars cent cents euro euros usd eur gbp degree degrees °c °f c f k watt watts
    kw kwh volt volts joule joules newton newtons meter meters metre metres kilometer kilometers
    """.split()
)
_NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*(?:%|[a-zA-Z°]{1,4})?")
_EDGES = re.compile(r"^[^\w$€£+\-]+|[^\w%°]+$")
_ENDS = re.compile(r"[.!?:;][\"'”’)\]]*$")
_WORD = re.compile(r"\w\S*")
_WORDS_KEPT = 600_000
PLAIN, SLOT, CAPITAL, UNIT, OPENS, EMPTY = 0, 1, 2, 4, 8, 16
_NUM, _NAME, _UNIT = (xxhash.xxh3_64_intdigest(x) for x in (b"\0num", b"\0name", b"\0unit"))


class Templates(dict):
    """Template words of texts; each written word is analysed once and numbered."""

    def __init__(self):
        super().__init__()
        self.codes, self.literals, self.flags = (np.zeros(_WORDS_KEPT, t) for t in (np.uint64, np.uint64, np.uint8))

    def __missing__(self, word: str) -> int:
        flags = OPENS if _ENDS.search(word) else 0
        core = _EDGES.sub("", word)
        low = core.lower()
        literal = code = xxhash.xxh3_64_intdigest(low.encode())
        if not core:
            flags |= EMPTY
        elif _NUMBER.fullmatch(core):
            code, flags = _NUM, flags | SLOT
        else:
            name = len(core) > 1 and core[0].isupper() and core[1:] != core[1:].upper()
            flags |= (CAPITAL if name else 0) | (UNIT if low in UNITS else 0)
        n = len(self)
        self.codes[n], self.literals[n], self.flags[n] = code, literal, flags
        self[word] = n
        return n

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Codes, whether each is a placeholder, literal codes, and the written words."""
        words = text.split()
        if len(self) + len(words) > _WORDS_KEPT:
            self.clear()
            if len(words) > len(self.codes):
                self.codes, self.literals, self.flags = (np.zeros(len(words), x.dtype) for x in (self.codes, self.literals, self.flags))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        codes, literals, flags = self.codes[at], self.literals[at], self.flags[at]
        opens = np.r_[True, (flags[:-1] & OPENS) > 0][: len(flags)]
        empty = (flags & EMPTY) > 0
        if empty.any():
            keep = np.flatnonzero(~empty)
            gone = np.maximum.accumulate(np.where(empty, np.arange(len(flags)), -1))
            # a sentence end that stands alone opens a sentence too
            opens = opens | ((gone == np.arange(len(flags)) - 1) & np.r_[False, (flags[:-1] & OPENS) > 0])
            codes, literals, flags, opens, words = codes[keep], literals[keep], flags[keep], opens[keep], [words[i] for i in keep]
        slots = (flags & SLOT) > 0
        names = ((flags & CAPITAL) > 0) & ~opens
        units = ((flags & UNIT) > 0) & np.r_[False, slots[:-1]][: len(slots)]
        codes = np.where(names, np.uint64(_NAME), codes)
        codes = np.where(units, np.uint64(_UNIT), codes)
        return codes, slots | names | units, literals, words

    def windows(self, text: str, size: int, sizes: list[int] | None = None, wanted: Wanted | None = None) -> list[tuple[int, int, int, list[str]]]:
        """Hash (signed), position, form (0: template, else size of a literal window), and slot values of the windows of a text, of those wanted.

        sizes: of literal windows; by default the text's own, size or all of a shorter text.
        """
        codes, slots, literals, words = self.of(text)
        found = []
        hashes = window_hashes(codes, size)
        some = wanted.among(hashes) if wanted else np.arange(len(hashes))
        if len(some):
            before = np.r_[0, np.cumsum(slots)]
            some = some[before[some + size] - before[some] <= size - MIN_PLAIN]
            value = lambda i: _EDGES.sub("", words[i]).lower()
            found = [(int(h), int(at), 0, [value(i) for i in range(at, at + size) if slots[i]]) for h, at in zip(hashes.view(np.int64)[some], some, strict=True)]
        for n in sizes if sizes is not None else [min(size, len(words))] if words else []:
            hashes = mixed(window_hashes(literals, n) + np.uint64(n))
            some = wanted.among(hashes) if wanted else np.arange(len(hashes))
            found += [(int(h), int(at), n, []) for h, at in zip(hashes.view(np.int64)[some], some, strict=True)]
        return found


class Wanted:
    """A set of hashes, tested for whole arrays."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.astype(np.int64).view(np.uint64))
        self.bits = np.uint64(max(16, int(len(self.hashes) * 16).bit_length()))
        self.table = np.zeros(1 << int(self.bits), bool)
        self.table[self.hashes >> (np.uint64(64) - self.bits)] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that are in the set."""
        some = np.flatnonzero(self.table[hashes >> (np.uint64(64) - self.bits)])
        if not len(some):
            return some
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        return some[self.hashes[at] == hashes[some]]


def template_windows(texts: DataFrame, key: str, size: int = WINDOW, sizes: list[int] | None = None, wanted=None) -> DataFrame:
    """key, hash, position, form, slots (values of its placeholders in order) for the windows of texts (columns key, text)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates, filter_ = Templates(), wanted.value if wanted else None
        for b in batches:
            rows = [(k, *w) for k, t in zip(b[key].tolist(), b["text"], strict=True) for w in templates.windows(t, size, sizes, filter_)]
            yield pd.DataFrame(rows, columns=[key, "hash", "position", "form", "slots"])

    return texts.mapInPandas(made, f"{key} long, hash long, position int, form int, slots array<string>")


def best_alignment(matches: list, n_windows: int, min_share: float = MIN_SHARE) -> tuple[int, int]:
    """Most windows that match consistently on alignments within a fifth of the item, and slot values there.

    matches: (shift, hash, [(item value, document value)]) of one document and item.
    """
    drift, least = max(1, n_windows // 5), min_share * n_windows
    matches = sorted(matches)
    best, low = (0, 0), 0
    for high, (shift, *_) in enumerate(matches):
        while matches[low][0] < shift - drift:
            low += 1
        last = high + 1 == len(matches) or matches[high + 1][0] > matches[low][0] + drift
        near = matches[low : high + 1]
        if not last or len({h for _, h, _ in near}) < least:
            continue
        met = Counter(pair for _, _, pairs in near for pair in pairs)
        into: dict[str, str] = {}
        taken: set[str] = set()
        for (mine, other), _ in sorted(met.items(), key=lambda x: (-x[1], x[0])):
            if mine not in into and other not in taken:
                into[mine] = other
                taken.add(other)
        whole = {h for _, h, pairs in near if all(into.get(a) == b for a, b in pairs)}
        best = max(best, (len(whole), len(into)))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_matched, share, n_slots, form for each document and item that it holds.

    The form (template, else literal; short: a literal one of fewer words than a window) with
    the larger share is told.  Null and empty texts
    have no windows and hold nothing; an item without words is never found.  Very long texts
    are taken whole.  Rows of benchmark that share an item_id are pooled, null item_ids too (as
    null); documents that share a doc_id are pooled, null doc_ids too.  Repeated rows change
    nothing; an empty table on either side gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    item = F.coalesce(F.col("item_id").cast("long"), F.lit(-(2**63))).alias("item")
    texts = benchmark.select(item, whole_text().alias("text"))
    items = stored(template_windows(texts, "item", size), "benchmark-windows")
    wanted = None
    if items.count() <= BROADCAST_WINDOWS:
        wanted = spark.sparkContext.broadcast(Wanted(np.array([r["hash"] for r in items.select("hash").distinct().collect()], np.int64)))
    sizes = [r["form"] for r in items.filter("form > 0").select("form").distinct().collect()]  # size of them at most
    found = template_windows(docs.select(doc_key().alias("_key"), whole_text().alias("text")), "_key", size, sizes, wanted)
    n_windows = items.groupBy("item", "form").agg(F.countDistinct("hash").alias("n_windows"))
    there = items.select("hash", "item", "form", F.col("position").alias("item_position"), F.col("slots").alias("item_slots"))
    pairs = F.transform("item_slots", lambda v, i: F.struct(v.alias("item"), F.get("slots", i).alias("doc")))
    match = F.struct((F.col("position") - F.col("item_position")).alias("shift"), "hash", pairs.alias("pairs"))
    grouped = found.join(there.hint("shuffle_hash"), ["hash", "form"]).groupBy("_key", "item", "form").agg(F.collect_set(match).alias("matches"))

    @F.pandas_udf("n_matched long, n_slots long")
    def aligned(matches: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [best_alignment([(m["shift"], m["hash"], [(p["item"], p["doc"]) for p in m["pairs"]]) for m in ms], k, min_share) for ms, k in zip(matches, n, strict=True)]
        return pd.DataFrame(rows, columns=["n_matched", "n_slots"])

    enough = F.size("matches") >= min_share * F.col("n_windows")
    judged = grouped.join(n_windows.hint("shuffle_hash"), ["item", "form"]).filter(enough).select("_key", "item", "form", "n_windows", aligned("matches", "n_windows").alias("m"))
    share = F.col("m.n_matched") / F.col("n_windows")
    whole = judged.select("_key", "item", F.struct(share.alias("share"), (F.col("form") == 0).alias("template"), (F.col("form") >= size).alias("literal"), "n_windows", "m.n_matched", "m.n_slots").alias("b")).filter(F.col("b.share") >= min_share)
    best = whole.groupBy("_key", "item").agg(F.max("b").alias("b"))
    return best.select(id_from(), F.when(F.col("item") != -(2**63), F.col("item")).alias("item_id"), "b.n_windows", "b.n_matched", "b.share", "b.n_slots", F.when(F.col("b.template"), "template").when(F.col("b.literal"), "literal").otherwise("short").alias("form"))


def lines_of_items(texts: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id of the texts (doc_id, text) of which a line is an item of fewer than ``size`` words, whatever its case and the punctuation around words."""
    spark = texts.sparkSession

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for b in batches:
            rows = []
            for key, text in zip(b["doc_id"].tolist(), b["text"], strict=True):
                for line in set(text.split("\n")):
                    if len([*islice(_WORD.finditer(line), size)]) == size:
                        continue
                    _, _, literals, words = templates.of(line)
                    if 0 < len(words) < size:
                        rows.append((key, int(mixed(window_hashes(literals, len(words)) + np.uint64(len(words))).view(np.int64)[0]), len(words)))
            yield pd.DataFrame(rows, columns=["doc_id", "hash", "n"])

    lines = lambda df: df.mapInPandas(hashed, "doc_id long, hash long, n int")
    items = benchmark.select(F.lit(0).cast("long").alias("doc_id"), F.regexp_replace(whole_text(), r"\s+", " ").alias("text"))
    short = stored(lines(items).select("hash", "n").distinct(), "short-items")
    if short.isEmpty():
        return spark.createDataFrame([], "doc_id long")
    return lines(texts).join(short.hint("shuffle_hash"), ["hash", "n"], "left_semi").select("doc_id").distinct()


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs whose text holds no item of benchmark; the columns stay.

    An item of fewer words than a window counts only where it is all of a line.  Rows are
    judged by their text, whatever their doc_id; null and empty texts stay, repeated rows share
    their verdict, and columns of any name stay as they are.
    """
    key = free_name(docs.columns, "_text_key")
    texts = docs.select(F.xxhash64(whole_text()).alias("doc_id"), whole_text().alias("text"))
    long = contaminated(texts, benchmark, size, min_share).filter("form <> 'short'").select("doc_id")
    found = stored(long.union(lines_of_items(texts, benchmark, size)).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, F.xxhash64(whole_text())).join(found.hint("shuffle_hash"), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])
