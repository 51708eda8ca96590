"""Near copies by the real similarity of their word shingles.

Two texts are linked if the Jaccard similarity of their sets of 5-word shingles is 0.8 or
more.  A 64-bit fingerprint can't promise to find such pairs (at 0.8 about ten bits differ,
so that no positional byte need be shared); here no pair is lost:

1. Texts that are equal up to case and white space are collapsed.  Of the rest, SimHash
   fingerprints that differ in two bits at most (``simhash.links``) give the first candidates;
   those similar by their shingles are linked, and what they connect isn't compared again.
2. All shingles are put in one order, and a text of n shingles is posted under its first
   n - ceil(0.8 n) + 1 ones.  Similar texts share a posting, the first shingle that both
   hold.  The order is by hash with frequent shingles last, the most frequent at the very end
   (which ones count as frequent changes the work, never the result), so what many texts
   quote is rarely posted.  What would
   be posted is counted over all texts for that, so no frequent shingle is missed because
   each task holds it once or twice.
3. Pairs of a posting pass if sizes and places allow the similarity.  In a posting of more
   than ``SMALL_POSTING`` texts all are compared with its centre, the text of the fewest rare
   shingles (of copies of one text that is the text itself, as edits are rare).
4. Candidates whose bitmaps differ too much go: a bit is the parity of the shingles in its cell,
   so shared ones cancel, and as many bits differ as shingles at most.  The rest are verified on
   all their shingles (64-bit hashes of the words), then components are formed.
5. Members of a centre that this leaves in different components are told apart by what they
   have beyond it.  Let x and y share a and b shingles with the centre.  They have at most
   min(a, b) of these in common, so to be similar they share shingles of their own, or min(a, b)
   is enough by itself.  For the first, members are posted once more under the first of their
   own shingles, few for near copies; the second can't be where y isn't smaller than a centre
   that x is not similar to, so only members apart from the centre meet smaller members.
   A pair is due only under the centre of the first shingle that it shares, so members meet
   only where their places in its postings allow the similarity.
   Lists of own shingles that are large again have a centre as well, before their rest is paired:
   where sizes and places allow it at the first own shingle that a pair shares, for which the
   smaller of the two needs the ninth of its shingles only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.llm import simhash
from docgauge.llm.components import components
from docgauge.llm.stage import doc_key, free_name, release, stored, whole_text
from docgauge.llm.words import window_hashes, word_codes

NEAR_WORDS = 5
SIMILARITY = 0.8
SMALL_POSTING = 32
#: Members of a list of own shingles up to which all pairs are counted; few, so that their number grows with the members.
SMALL_OWN = 6
#: Frequent shingles that are broadcast at most, the most frequent ones.
FREQUENT = 200_000
_SLACK = 1e-9


def shingles(text: str, words: int = NEAR_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different word shingles, A-Z in lower case; a text of fewer words is one shingle, one without words has none."""
    row = word_codes(text.encode().lower())
    return np.unique(window_hashes(row, min(words, max(len(row), 1))).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - _SLACK:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared >= similarity * (len(a) + len(b) - shared) - _SLACK


def _posted(n: int, similarity: float) -> int:
    """Shingles that a text of n posts: the fewest that meet any similar text."""
    return max(n - math.ceil(similarity * n - _SLACK) + 1, 0)


def _frequent(texts: DataFrame, words: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, sorted, and the place of each by how many hold it (from 1, the most frequent last).

    All that a text would post by hash alone are counted, and a tenth more, as what is put
    last lets others in; of those behind only what a task holds more than twice.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), 2000):
                found = [np.empty(0, "int64"), *[shingles(t, words) for t in b["text"].iloc[low : low + 2000]]]
                value, n = np.unique(np.concatenate(found), return_counts=True)
                kept = n > 2
                kept[np.searchsorted(value, np.concatenate([x[: math.ceil(1.1 * _posted(len(x), similarity))] for x in found]))] = True
                yield pd.DataFrame({"posting": value[kept], "n": n[kept].astype("int32")})

    counts = texts.select("text").mapInPandas(counted, "posting long, n int").groupBy("posting").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") > SMALL_POSTING).orderBy(F.desc("n"), "posting").limit(FREQUENT).collect()
    value = np.array([r["posting"] for r in rows], "int64")
    by_value = np.argsort(value)
    return value[by_value], len(value) - by_value


def _places(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The place of each of found among the frequent shingles, 0 for rare ones."""
    value, place = frequent
    if not len(value):
        return np.zeros(len(found), "int64")
    at = np.minimum(np.searchsorted(value, found), len(value) - 1)
    return np.where(value[at] == found, place[at], 0)


def _prefix(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], shared: int) -> tuple[np.ndarray, int]:
    """The first of found in the common order, enough to meet any other set that shares so many; how many of found are rare."""
    place = _places(found, frequent)
    return found[np.lexsort((found, place))][: max(len(found) - shared + 1, 0)], int(len(found) - np.count_nonzero(place))


def _postings(texts: DataFrame, words: int, similarity: float, frequent) -> DataFrame:
    """posting, first, n (shingles of the text), at (place of the posting in their order), rare (shingles that aren't frequent)."""

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), 1000):
                made = [], [], [], [], []
                for key, text in zip(b["first"].iloc[low : low + 1000].tolist(), b["text"].iloc[low : low + 1000], strict=True):
                    found = shingles(text, words)
                    if not (n := len(found)):
                        continue
                    found, rare = _prefix(found, frequent.value, math.ceil(similarity * n - _SLACK))
                    for out, x in zip(made, (found, np.full(len(found), key), np.full(len(found), n), np.arange(len(found)), np.full(len(found), rare)), strict=True):
                        out.append(x)
                if made[0]:
                    yield pd.DataFrame(dict(zip(("posting", "first", "n", "at", "rare"), map(np.concatenate, made), strict=True)))

    return texts.select("first", "text").mapInPandas(posted, "posting long, first long, n int, at int, rare int")


def _needed(n: Column, m: Column, similarity: float) -> Column:
    """Shingles that similar sets of these sizes share at least."""
    return (n + m) * (similarity / (1 + similarity)) - _SLACK


def _fit(x: str, y: str, similarity: float) -> Column:
    """Whether two members of a posting can be similar, as it is the first shingle that they share."""
    n, m, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.at"), F.col(f"{y}.at")
    return F.least(n - i, m - j) >= _needed(n, m, similarity)


_COMPARED = "a long, b long, similar boolean, at int, n_a int, n int, shared int, own array<long>"
#: at of pairs that aren't star pairs.
_PLAIN = -1


def _compared(pairs: DataFrame, texts: DataFrame, words: int, similarity: float, frequent, name: str) -> DataFrame:
    """a, b, similar of pairs (a, b, at), stored; of star pairs also at, sizes, what they share, and the first own shingles of b."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, known = None, None
        for b in batches:
            for low in range(0, len(b), 1000):
                out = []
                for one, two, at, x, y in b.iloc[low : low + 1000][["a", "b", "at", "text_a", "text_b"]].itertuples(index=False):
                    if one != last:  # successive pairs often share a text
                        last, known = one, shingles(x, words)
                    other = shingles(y, words)
                    if at == _PLAIN:
                        out.append((one, two, similar(known, other, similarity), at, 0, 0, 0, None))
                        continue
                    own = np.setdiff1d(other, known, assume_unique=True)
                    shared, n = len(other) - len(own), len(other)
                    alike = shared >= similarity * (len(known) + len(own)) - _SLACK
                    first, _ = _prefix(own, frequent.value, max(1, math.ceil(similarity * n - shared - _SLACK)))
                    out.append((one, two, alike, at, len(known), n, shared, first))
                yield pd.DataFrame(out, columns=["a", "b", "similar", "at", "n_a", "n", "shared", "own"])

    side = lambda c: texts.select(F.col("first").alias(c), F.col("text").alias(f"text_{c}"))
    # Written out, so that the second join deals the pairs anew and Spark can split a centre with very many members.
    half = stored(pairs.select("a", "b", "at").join(side("b").hint("merge"), "b"), "near-half")
    made = stored(half.join(side("a").hint("merge"), "a").mapInPandas(compared, _COMPARED), name)
    release(half)
    return made


def _small_pairs(lists: DataFrame, keys: list[str], member: list[str], fits: Column) -> DataFrame:
    """keys and the members x, y of each (short) list for which fits holds."""
    few = lists.groupBy(*keys).agg(F.collect_list(F.struct(*member)).alias("members")).select(*keys, "members", F.explode("members").alias("x"))
    return few.select(*keys, "x", F.explode("members").alias("y")).filter((F.col("x.first") < F.col("y.first")) & fits)


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingle hashes as a signed number: a bit is set if more than half of them set it; 0 without any."""
    mixed = found.view("uint64") * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    ones = np.zeros(64, "int64")
    for at in range(0, len(mixed), 65_536):
        ones += np.unpackbits(mixed[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * ones > len(mixed), bitorder="little").view("<i8")[0])


def bitmap(found: np.ndarray) -> bytes:
    """Parities of a set of shingle hashes in twice as many cells or more, a power of two; the halves of a larger one, folded, are a smaller one."""
    cells = max(64, 1 << (2 * len(found)).bit_length())
    at = (found.view("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) & np.uint64(cells - 1)
    return np.packbits(np.bincount(at.astype("int64"), minlength=cells) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Shingles at least that one of the sets with these bitmaps holds and the other doesn't."""
    x, y = sorted((x, y), key=len)
    one, two, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(y)
    while bits > 8 * len(x):
        bits //= 2
        two = two >> bits ^ two & (1 << bits) - 1
    return (one ^ two).bit_count()


def _marks(texts: DataFrame, words: int) -> DataFrame:
    """first, n (shingles), fingerprint and bitmap of each text, stored."""

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), 1000):
                part = b.iloc[low : low + 1000]
                each = [(len(x), fingerprint(x), bitmap(x)) for x in (shingles(t, words) for t in part["text"])]
                yield pd.DataFrame(each, columns=["n", "fingerprint", "bits"]).assign(first=part["first"].to_numpy())

    return stored(texts.select("first", "text").mapInPandas(marked, "n int, fingerprint long, bits binary, first long"), "near-marks")


def _sifted(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b, at) without those whose bitmaps tell that they aren't similar; star pairs stay."""

    @F.pandas_udf("boolean")
    def possible(n: pd.Series, x: pd.Series, m: pd.Series, y: pd.Series) -> pd.Series:
        both = zip(n.tolist(), x, m.tolist(), y, strict=True)
        return pd.Series([(i + j - differing(p, q)) / 2 >= (i + j) * (similarity / (1 + similarity)) - _SLACK for i, p, j, q in both], dtype=bool)

    side = lambda c: marks.select(F.col("first").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    met = pairs.filter(F.col("at") == _PLAIN).join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    return met.filter(possible("n_a", "bits_a", "n_b", "bits_b")).select("a", "b", "at").union(pairs.filter(F.col("at") != _PLAIN).select("a", "b", "at"))


def simhash_candidates(texts: DataFrame, words: int = NEAR_WORDS, marks: DataFrame | None = None) -> DataFrame:
    """a, b: pairs of texts whose SimHash fingerprints differ in two bits at most, enough of them to connect all such texts."""
    each = (marks or _marks(texts, words)).select("fingerprint", "first")
    distinct = stored(each.groupBy("fingerprint").agg(F.min("first").alias("least")), "near-distinct")
    equal = each.join(distinct.hint("shuffle_hash"), "fingerprint").filter("first <> least").select(F.col("least").alias("a"), F.col("first").alias("b"))
    other = simhash.links(distinct.withColumnRenamed("least", "first"))
    return equal.union(other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def near_links(texts: DataFrame, words: int = NEAR_WORDS, similarity: float = SIMILARITY, small: int | None = None) -> DataFrame:
    """a, b: links between similar texts (first, text), enough of them to connect all similar ones.

    small: what counts as a large list, of postings and of own shingles (SMALL_POSTING and SMALL_OWN by default).
    """
    small, small_own = (SMALL_POSTING, SMALL_OWN) if small is None else (small, small)
    frequent = texts.sparkSession.sparkContext.broadcast(_frequent(texts, words, similarity))
    marks = _marks(texts, words)
    compare = lambda pairs, name: _compared(_sifted(pairs, marks, similarity), texts, words, similarity, frequent, name)
    by_bits = compare(simhash_candidates(texts, words, marks).withColumn("at", F.lit(_PLAIN)), "near-simhash").filter("similar").select("a", "b")
    posting = Window.partitionBy("posting")
    centre = F.min(F.struct("rare", "first")).over(posting)["first"]
    shared = stored(_postings(texts, words, similarity, frequent).withColumns({"size": F.count("*").over(posting), "centre": centre}).filter("size > 1"), "near-shared")
    fitting = _small_pairs(shared.filter(F.col("size") <= small), ["posting"], ["first", "n", "at"], _fit("x", "y", similarity)).select(F.col("x.first").alias("a"), F.col("y.first").alias("b"))
    starred = shared.filter((F.col("size") > small) & (F.col("first") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("first").alias("b"), "at")
    # at: the first place at which b is posted with the centre a.
    pairs = stored(fitting.withColumn("at", F.lit(None).cast("int")).union(starred).groupBy("a", "b").agg(F.coalesce(F.min("at"), F.lit(_PLAIN)).alias("at")), "near-pairs")
    release(shared)
    # Members of a centre are compared with it in any case: what they share with it tells them apart.
    known = _parts(by_bits)
    open_ = _with_parts(stored(_with_parts(pairs, known, "b", "part"), "near-half-placed"), known, "a", "home").filter((F.col("at") != _PLAIN) | F.expr("part <> home")).select("a", "b", "at")
    first = compare(open_, "near-first")
    release(pairs)
    found = first.filter("similar").select("a", "b").union(by_bits)
    return found.union(_apart(first.filter("own IS NOT NULL"), found, compare, similarity, small_own))


def _parts(links: DataFrame) -> DataFrame:
    return stored(components(links, "near-parts"), "near-components")


def _with_parts(rows: DataFrame, parts: DataFrame, of: str, name: str) -> DataFrame:
    joined = rows.join(parts.select(F.col("node").alias(of), F.col("component").alias(name)).hint("merge"), of, "left")
    return joined.withColumn(name, F.coalesce(name, of))


def _apart(stars: DataFrame, found: DataFrame, compare, similarity: float, small: int) -> DataFrame:
    """Links between members of a centre that found leaves in different components."""
    parts = _parts(found)
    # Written out between the joins, so that each deals the rows anew and Spark can split a hot centre.
    half = stored(_with_parts(stars, parts, "b", "part"), "near-half-placed")
    placed = stored(_with_parts(half, parts, "a", "home"), "near-placed")
    release(half)
    open_ = stored(placed.groupBy("a").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("a"), "near-open")
    left = stored(placed.join(open_.hint("merge"), "a", "left_semi").select("a", F.col("b").alias("first"), "part", "home", "at", "n_a", "n", "shared", (F.col("n") - F.col("shared")).alias("beyond"), "own"), "near-left")
    release(placed)
    col = lambda side, name: F.col(f"{side}.{name}")
    of = lambda name, which: which(col("x", name), col("y", name))
    differ = col("x", "part") != col("y", "part")
    missing = _needed(col("x", "n"), col("y", "n"), similarity) - of("shared", F.least)
    due = differ & _fit("x", "y", similarity)
    # What the centre alone allows: members apart from it and smaller ones.
    x = left.filter("part <> home").select("a", "first", "part", "at", "n", "shared").alias("x")
    y = left.filter("n < n_a").select("a", "first", "part", "at", "n", "shared").alias("y")
    through = x.join(y.hint("merge"), (col("x", "a") == col("y", "a")) & due & (missing <= 0)).select(of("first", F.least).alias("a"), of("first", F.greatest).alias("b"))
    # What own shingles allow.
    member = ["first", "part", "at", "n", "shared", "beyond"]
    own = stored(left.select("a", *member, (F.col("beyond") - F.size("own")).alias("behind"), F.posexplode("own").alias("place", "shingle")), "near-own")
    sizes = own.groupBy("a", "shingle").agg(F.count("*").alias("size"), F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.struct("beyond", "first"))["first"].alias("centre")).filter("low < high")
    lists = stored(own.join(stored(sizes, "near-sizes").hint("merge"), ["a", "shingle"]), "near-lists")
    fits = due & (missing <= of("beyond", F.least))
    release(own)
    large = lists.filter(F.col("size") > small)
    # Own shingles that a pair shares: those of small lists are counted, of the rest no more than a member has can be shared.
    in_large = large.groupBy("a", "first").agg(F.count("*").cast("int").alias("large"))
    few = lists.filter(F.col("size") <= small).join(in_large.hint("merge"), ["a", "first"], "left").na.fill(0, ["large"])
    open_to = missing - of("large", F.least) - (col("x", "behind") + col("y", "behind"))
    counted = _small_pairs(few, ["a", "shingle"], [*member, "behind", "large"], fits).select("a", col("x", "first").alias("x"), col("y", "first").alias("y"), open_to.alias("least"))
    pairs = counted.groupBy("a", "x", "y").agg(F.count("*").alias("n"), F.max("least").alias("least")).filter("n >= least").select(F.col("x").alias("a"), F.col("y").alias("b")).union(through)
    more = large.filter("first <> centre").select(F.col("centre").alias("a"), F.col("first").alias("b"))
    again = compare(pairs.union(more).distinct().withColumn("at", F.lit(_PLAIN)), "near-second").filter("similar").select("a", "b")
    if large.isEmpty():
        return again
    parts = _parts(found.union(again))
    rest = stored(_with_parts(large.drop("part", "low", "high"), parts, "first", "part"), "near-rest")
    opened = rest.groupBy("a", "shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("a", "shingle")
    rest = rest.join(stored(opened, "near-open").hint("merge"), ["a", "shingle"], "left_semi")
    # open: own shingles from this one on that others hold.
    rest = stored(rest.withColumn("open", F.count("*").over(Window.partitionBy("a", "first").orderBy(F.desc("place")))), "near-rest")
    # What met in no small list meets here at the first own shingle that it shares, and shares only open ones and those behind; y is the smaller one.
    least = _needed(F.col("n"), F.col("n"), similarity)
    x, y = rest.alias("x"), rest.filter((F.col("n") - F.col("at") >= least) & (F.col("beyond") - F.col("place") >= least - F.col("shared"))).alias("y")
    smaller = F.struct("y.n", "y.first") < F.struct("x.n", "x.first")
    possible = F.least(col("x", "beyond") - col("x", "place"), col("y", "beyond") - col("y", "place"), of("open", F.least) + of("behind", F.greatest))
    both = x.join(y.hint("merge"), (col("x", "a") == col("y", "a")) & (col("x", "shingle") == col("y", "shingle")) & smaller & due & (missing <= possible))
    last = compare(both.select(of("first", F.least).alias("a"), of("first", F.greatest).alias("b")).distinct().withColumn("at", F.lit(_PLAIN)), "near-third")
    return again.union(last.filter("similar").select("a", "b"))


def row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row; rows that repeat share it."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def one_of_each(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each group of near copies, the one of least doc_id; the columns stay.

    Rows are judged, not ids: of rows that repeat one stays, and rows that share a doc_id but
    differ in text are documents of their own.  Null doc_ids come before all others.  Ties of
    doc_id go by a hash of the row.  Null and empty texts and texts without words count as
    copies of each other.  Very long texts are taken whole.  An empty table gives no rows;
    columns of any name stay as they are.
    """
    row, key = (free_name(docs.columns, c) for c in ("_row", "_key"))

    @F.pandas_udf("long")
    def digest(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([xxhash.xxh3_64_intdigest(b" ".join(t.encode().lower().split())) for t in text], "uint64").view("int64"))

    marked = stored(docs.select(doc_key().alias("key"), row_hash(docs).alias("row"), digest(whole_text()).alias("node")), "near-digests")
    firsts = stored(marked.groupBy("node").agg(F.min(F.struct("key", "row")).alias("least")).select("node", "least.*"), "near-firsts")
    each = docs.select(row_hash(docs).alias("row"), doc_key().alias("key"), whole_text().alias("text")).join(firsts.hint("shuffle_hash"), ["key", "row"]).select(F.col("node").alias("first"), "text").dropDuplicates(["first"])
    texts = stored(each, "near-texts")
    release(marked)
    links = near_links(texts, words, similarity)
    release(texts)
    found = components(links, "near-all")
    classes = firsts.join(found.hint("shuffle_hash"), "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min(F.struct("key", "row")).alias("least"))
    kept = stored(classes.select(F.col("least.key").alias(key), F.col("least.row").alias(row)), "near-kept")
    rows = docs.select("*", doc_key().alias(key), row_hash(docs).alias(row)).join(kept.hint("shuffle_hash"), [key, row], "left_semi")
    return rows.dropDuplicates([key, row]).select(*[f"`{c}`" for c in docs.columns])
