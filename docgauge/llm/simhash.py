"""Near-duplicate documents by SimHash, found over a byte-position inverted index.

Fingerprints have eight bytes.  Two fingerprints that differ in at most two bits agree in at
least six of the eight positional bytes: the guaranteed minimum of matches.

1. Lists: the inverted index on single positional bytes would have lists of 1/256 of all
   fingerprints, whose pairs grow with the square of the corpus.  So a list is keyed by four
   positional bytes at once (every choice of two of the four byte pairs, six lists a
   fingerprint).  Two fingerprints with six equal bytes share at least one list, which counts
   for four matches.
2. Tally: within a list, fingerprints are posted once more under each positional byte outside
   its key.  Pairs that meet there are tallied by groupBy; those with two meetings and more, so
   six matches and more in all, are kept (count filter), and then verified bit by bit.
3. A list of more than ``SMALL_LIST`` fingerprints is split by two further positional bytes
   (six lists for each), whose members share six bytes.  Small ones are verified pair by pair.
   A list that is large even then (members that differ in two bytes only) isn't expanded into
   pairs: each member is posted at itself and at its 16 neighbours in these two bytes.
   Members differ in at most two bits exactly if they share such a point, so links to the
   first member at each point lose no link, with 17 rows a member.

Copies are collapsed first, so lists hold different fingerprints only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.llm.components import components
from docgauge.llm.stage import doc_key, id_from, stored, whole_text

SHINGLE_WORDS = 3
MAX_BITS = 2
SMALL_LIST = 32
_SEED = 42


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """SimHash of the XXH64 of all word shingles, as an unsigned integer."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, _SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), "int64", len(parts)) + 1)
        starts = np.r_[0, ends[: -words]].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], _SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    values = np.array(hashes, "<u8")
    ones = np.zeros(64, "int64")
    for at in range(0, len(values), 65_536):
        ones += np.unpackbits(values[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """_key, fingerprint (signed long) of every row."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in b], "uint64").view("int64"))

    return docs.select(doc_key().alias("_key"), simhash(whole_text()).alias("fingerprint"))


def _bits(number: Column, first: int, n: int) -> Column:
    return F.shiftrightunsigned(number, first).bitwiseAND(F.lit((1 << n) - 1))


def _byte(fp: Column, at: int) -> Column:
    return _bits(fp, 8 * at, 8)


def _mask(positions: tuple[int, ...]) -> int:
    """A long with all bits of these bytes set."""
    mask = sum(0xFF << 8 * p for p in positions)
    return mask - 2**64 if mask >= 2**63 else mask


#: Positional bytes of the lists' keys: every choice of two byte pairs; and for each, what lies outside.
KEYS = [tuple(b for pair in choice for b in (2 * pair, 2 * pair + 1)) for choice in combinations(range(4), 2)]
REST = [tuple(b for b in range(8) if b not in key) for key in KEYS]


def _lists(distinct: DataFrame) -> DataFrame:
    """choice, bytes (the key's, others 0), fingerprint, first."""
    keys = [F.struct(F.lit(n).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(_mask(key)).cast("long")).alias("bytes")) for n, key in enumerate(KEYS)]
    return distinct.select("fingerprint", "first", F.explode(F.array(*keys)).alias("k")).select("k.*", "fingerprint", "first")


def _by_choice(of) -> Column:
    """A column that depends on the choice: of(n) for each."""
    cases = F.when(F.col("choice") == 0, of(0))
    for n in range(1, len(KEYS)):
        cases = cases.when(F.col("choice") == n, of(n))
    return cases


def _pairs(lists: DataFrame, keys: list[str]) -> DataFrame:
    """x, y: the pairs of members of each list (a bounded number of them), by fingerprint."""
    member = F.struct("fingerprint", "first")
    grouped = lists.groupBy(*keys).agg(F.array_sort(F.collect_list(member)).alias("members")).filter(F.size("members") > 1)
    each = grouped.select(*keys, "members", F.posexplode("members").alias("at", "x"))
    return each.select(*keys, "x", F.explode(F.slice("members", F.col("at") + 2, F.size("members"))).alias("y"))


def _near(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs that differ in at most MAX_BITS bits."""
    return pairs.filter(F.bit_count(F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint"))) <= MAX_BITS).select(F.col("x.first").alias("a"), F.col("y.first").alias("b"))


def tallied(lists: DataFrame) -> DataFrame:
    """x, y, matches: pairs of members of small lists with the positional bytes that they share, at least the guaranteed minimum."""
    postings = _by_choice(lambda n: F.array(*[F.struct(F.lit(p).alias("position"), _byte(F.col("fingerprint"), p).alias("byte")) for p in REST[n]]))
    posted = lists.select("choice", "bytes", "fingerprint", "first", F.explode(postings).alias("p")).select("choice", "bytes", "p.*", "fingerprint", "first")
    met = _pairs(posted, ["choice", "bytes", "position", "byte"])
    tally = met.groupBy("choice", "bytes", "x", "y").agg((F.count("*") + 4).alias("matches"))
    return tally.filter(F.col("matches") >= 8 - MAX_BITS).select("x", "y", "matches")


def links(distinct: DataFrame, small: int = SMALL_LIST) -> DataFrame:
    """a, b: first documents of fingerprints that differ in at most two bits, enough of them to connect all such fingerprints."""
    lists = stored(_lists(distinct), "lists")
    sizes = stored(lists.groupBy("choice", "bytes").agg(F.count("*").alias("n")).filter("n > 1"), "list-sizes")
    shared = stored(lists.join(sizes.hint("shuffle_hash"), ["choice", "bytes"]), "lists-shared")
    near = _near(tallied(shared.filter(F.col("n") <= small).drop("n")))
    # Large lists, by two further bytes; free: the two that are left.
    splits = _by_choice(lambda n: F.array(*[F.struct(F.lit(_mask(KEYS[n] + more)).cast("long").alias("mask")) for more in combinations(REST[n], 2)]))
    split = shared.filter(F.col("n") > small).select("fingerprint", "first", F.explode(splits).alias("k")).select(F.col("k.mask").alias("choice"), F.col("fingerprint").bitwiseAND(F.col("k.mask")).alias("bytes"), "fingerprint", "first").distinct()
    split = stored(split, "lists-split")
    split_sizes = stored(split.groupBy("choice", "bytes").agg(F.count("*").alias("n")).filter("n > 1"), "split-sizes")
    split_shared = stored(split.join(split_sizes.hint("shuffle_hash"), ["choice", "bytes"]), "split-shared")
    verified = _near(_pairs(split_shared.filter(F.col("n") <= small), ["choice", "bytes"]))
    bit = lambda i: F.lit((1 << i) - 2**64 if i == 63 else 1 << i).cast("long")
    free = F.filter(F.array(F.lit(0).cast("long"), *[bit(i) for i in range(64)]), lambda m: m.bitwiseAND(F.col("choice")) == 0)
    points = split_shared.filter(F.col("n") > small).select("choice", "first", F.explode(F.transform(free, lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("point"))
    centres = points.groupBy("choice", "point").agg(F.min("first").alias("centre"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = points.join(centres.hint("shuffle_hash"), ["choice", "point"]).filter("first <> centre").select(F.col("first").alias("a"), F.col("centre").alias("b"))
    return near.union(verified).union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    component_id is the smallest doc_id reachable over links, itself included.  Null and empty
    texts and texts without words have fingerprint 0 and are linked like others; very long
    texts are taken whole.  A bit that half the shingles set (a tie) is 0.  A null doc_id counts
    as one document before all others (its component_id is null); rows that repeat or share a
    doc_id give one row each; an empty table gives no rows.  Other columns are ignored.
    """
    marked = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(marked.groupBy("fingerprint").agg(F.min("_key").alias("first")), "distinct")
    found = components(links(distinct), "simhash-links")
    classes = stored(distinct.join(found.withColumnRenamed("node", "first").hint("shuffle_hash"), "first", "left").select("fingerprint", F.coalesce("component", "first").alias("component")), "classes")
    return marked.join(classes.hint("shuffle_hash"), "fingerprint").select(
        id_from(), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), id_from("component").alias("component_id")
    )
