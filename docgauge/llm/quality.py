"""Document quality by weak supervision; DataFrame functions only.

Rules look at one property each and vote good (1), bad (-1) or abstain (0).  Each property has
a strict rule and a loose one, so that rules overlap and loose ones are often wrong.
Expectation-maximisation over the vote patterns of all documents estimates, without labels,
the share of good documents and for every rule how often it votes bad on good and on bad
documents; the posterior probability of good given a document's votes replaces
all-must-pass filtering.  What is believed beforehand (``BELIEFS``) counts like a few votes, so
the corpus overrules it.  An iteration reads the table of vote patterns, whose size depends on
the rules and hardly on the corpus (some hundred); the driver holds the 2 * rules + 1
estimates only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.llm.stage import free_name, stored, whole_text

#: Fixed values of the base counts.
SPACES = " \t\n\x0b\x0c\r"
SPLIT_AT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Columns that features() adds.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_letters_digits", "n_upper", "n_lower", "n_bangs", "n_distinct_words")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _removed(text: Column, chars: str) -> Column:
    """How many characters of text are among chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    windows = F.transform(F.slice(words, 1, n - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = _let(ordered, lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])))
        words_in = F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.size(F.array_distinct(words_in))).otherwise(0)

    return F.when(n >= 4, _let(windows, covered)).otherwise(0).cast("long")


def features(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, more (columns of docs) and the counts that the rules use, of every whole text."""
    text = F.col("text")
    rows = docs.select("doc_id", whole_text().alias("text"), *more)
    own = [c for c in rows.columns if c != "text"]
    with_word = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)

    def counts(words: Column) -> Column:
        n = F.size(words)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            _repeat_words(words, n).alias("n_repeat_words"),
        )

    def lines(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(found, lambda line: F.right(F.btrim(line, F.lit(SPACES)), F.lit(1)).isin(".", "!", "?", ":", ";", '"', "”", "…", "。", "！", "？"))).cast("long").alias("n_ended_lines"),
        )

    made = rows.select(
        *own,
        _let(F.filter(F.split(text, SPLIT_AT), lambda w: w != ""), counts).alias("w"),
        _let(with_word, lines).alias("l"),
        (F.length(text).cast("long") - _removed(text, SPACES)).alias("word_chars"),
        _removed(text, SYMBOLS).alias("n_symbols"),
        _removed(text, "!").alias("n_bangs"),
        F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_letters_digits"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, r"[^\p{Ll}]+", "")).cast("long").alias("n_lower"),
    )
    return made.select(*own, "w.*", "l.*", "word_chars", "n_symbols", "n_bangs", "n_letters_digits", "n_upper", "n_lower").select(*own, *FEATURES)


def _vote(bad: Column, good: Column, known: Column) -> Column:
    return F.when(known & bad, -1).when(known & good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name: each tells what the rule calls bad and what good; between them, and where there is nothing to see, it abstains."""
    words, lines, cased = F.col("n_words"), F.col("n_lines"), F.col("n_upper") + F.col("n_lower")
    share = lambda part, whole: F.col(part) / F.greatest(whole, F.lit(1))
    symbols, upper, bangs = share("n_symbols", words), share("n_upper", cased), share("n_bangs", words)
    repeated, copied, ended = share("n_repeat_words", words), share("n_dup_lines", lines), share("n_ended_lines", lines)
    distinct, length, letters = share("n_distinct_words", words), share("word_chars", words), share("n_letters_digits", F.col("word_chars"))
    return {
        "symbols": _vote(symbols > 0.1, symbols < 0.02, words > 0),
        "any_symbols": _vote(symbols > 0.02, symbols <= 0.005, words > 0),
        "letters_digits": _vote(letters < 0.88, letters > 0.93, words > 0),
        "few_letters_digits": _vote(letters < 0.92, letters > 0.95, words > 0),
        "upper_case": _vote(upper > 0.4, upper < 0.15, cased >= 20),
        "some_upper_case": _vote(upper > 0.2, upper < 0.1, cased >= 20),
        "shouting": _vote(bangs > 0.25, bangs < 0.05, words > 0),
        "some_shouting": _vote(bangs > 0.1, bangs < 0.02, words > 0),
        "repetition": _vote(repeated > 0.3, repeated < 0.15, words >= 20),
        "some_repetition": _vote(repeated > 0.1, repeated < 0.05, words >= 20),
        "copied_lines": _vote(copied > 0.5, copied == 0, lines >= 3),
        "some_copied_lines": _vote(copied > 0.1, copied == 0, lines >= 3),
        "word_length": _vote((length < 2.5) | (length > 10), length.between(3.5, 7.5), words >= 20),
        "odd_word_length": _vote((length < 4) | (length > 8), length.between(4.5, 7), words >= 20),
        "line_ends": _vote(ended < 0.1, ended > 0.7, lines >= 3),
        "few_line_ends": _vote(ended < 0.5, ended > 0.9, lines >= 2),
        "vocabulary": _vote(distinct < 0.15, distinct > 0.3, words.between(50, 2000)),
        "small_vocabulary": _vote(distinct < 0.3, distinct > 0.5, words.between(50, 2000)),
    }


@dataclass(frozen=True)
class Accuracies:
    """share: of good documents; on_good, on_bad: by rule, how often it votes bad on them when it votes."""

    share: float
    on_good: dict[str, float] = field(default_factory=dict)
    on_bad: dict[str, float] = field(default_factory=dict)

    def posterior(self) -> Column:
        """Probability of good, given the vote columns."""
        weigh = lambda v, p, q: F.when(F.col(v) == -1, log(p / q)).when(F.col(v) == 1, log((1 - p) / (1 - q))).otherwise(0.0)
        terms = [weigh(v, self.on_bad[v], self.on_good[v]) for v in self.on_good]
        return 1 / (1 + F.exp(reduce(lambda a, b: a + b, terms, F.lit(log((1 - self.share) / self.share)))))


#: What is believed before a vote is counted, as (for, against): of good documents, of bad votes on good ones, of bad votes on bad ones.
BELIEFS = {"share": (7.0, 3.0), "on_good": (0.2, 9.8), "on_bad": (3.0, 7.0)}


def fit(patterns: DataFrame, names: list[str], iterations: int = 200, tolerance: float = 1e-5) -> Accuracies:
    """Expectation-maximisation over vote patterns (columns names, and n: documents with that pattern).

    Estimates are what is believed beforehand and the votes together; no estimate is bounded.
    """
    rate = lambda found, of, belief: (found + belief[0]) / (of + sum(belief))
    believed = {k: rate(0, 0, v) for k, v in BELIEFS.items()}
    now = Accuracies(believed["share"], dict.fromkeys(names, believed["on_good"]), dict.fromkeys(names, believed["on_bad"]))
    for _ in range(iterations):
        scored = patterns.withColumn("good", F.col("n") * now.posterior())
        sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
        for v in names:
            for kind, weight in (("good", F.col("good")), ("all", F.col("n"))):
                sums.append(F.sum(F.when(F.col(v) != 0, weight).otherwise(0)).alias(f"{v}_{kind}_votes"))
                sums.append(F.sum(F.when(F.col(v) == -1, weight).otherwise(0)).alias(f"{v}_{kind}_bad"))
        s = scored.agg(*sums).first()
        if not s["n"]:
            return now
        on_good = {v: rate(s[f"{v}_good_bad"], s[f"{v}_good_votes"], BELIEFS["on_good"]) for v in names}
        # never below nothing, whatever rounding did to the difference
        on_bad = {v: rate(max(s[f"{v}_all_bad"] - s[f"{v}_good_bad"], 0), max(s[f"{v}_all_votes"] - s[f"{v}_good_votes"], 0), BELIEFS["on_bad"]) for v in names}
        new = Accuracies(rate(s["good"], s["n"], BELIEFS["share"]), on_good, on_bad)
        change = max(abs(new.share - now.share), *(abs(new.on_bad[v] - now.on_bad[v]) for v in names), *(abs(new.on_good[v] - now.on_good[v]) for v in names))
        now = new
        if change < tolerance:
            break
    return now


def _voted(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, more, the counts and votes of every row."""
    votes = {f"vote_{name}": vote for name, vote in rules().items()}
    return features(docs, *more).select("*", *[v.cast("int").alias(k) for k, v in votes.items()])


def _judged(voted: DataFrame, threshold: float) -> DataFrame:
    votes = [f"vote_{name}" for name in rules()]
    patterns = stored(voted.groupBy(*votes).agg(F.count("*").alias("n")), "vote-patterns")
    learned = fit(patterns, votes)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = voted.withColumns({"base_failed": failed, "p_good": learned.posterior()})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, a vote column (vote_...) for each rule, base_failed, p_good and kept for every row of docs.

    base_failed: under 50 words, or more than half of them in repeated 3-word windows.
    kept: not base_failed, and p_good of threshold or more (a tie is kept).  A null or empty
    text has no words, all rules abstain, and it fails the base; very long texts are counted
    whole.  A null doc_id stays null; repeated rows give a row each; other columns are ignored;
    an empty table gives no rows.
    """
    return _judged(stored(_voted(docs), "quality"), threshold)


def good_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text quality() keeps, all their columns unchanged.

    Rows are judged by their text, whatever their doc_id, so rows that repeat stay or go
    together; null and empty texts go; columns of any name stay as they are.
    """
    key = free_name(docs.columns, "_text_key")
    voted = stored(_voted(docs, F.xxhash64(whole_text()).alias(key)), "quality")
    kept = stored(_judged(voted, threshold).filter("kept").select(key).distinct(), "good")
    return docs.withColumn(key, F.xxhash64(whole_text())).join(kept.hint("shuffle_hash"), key, "left_semi").select(*[f"`{c}`" for c in docs.columns])
