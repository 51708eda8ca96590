"""Near copies against brute-force Jaccard over all pairs."""

import random

import numpy as np
import pytest

from docgauge.llm import near
from tests.llm.conftest import SCHEMA


def brute_kept(texts: dict[int, str]) -> set[int]:
    def shingles(text: str) -> set[str]:
        words = text.encode().lower().split()
        return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    def similar(a: set, b: set) -> bool:
        return len(a & b) >= 0.8 * len(a | b) - 1e-9

    sets = {d: shingles(t) for d, t in texts.items()}
    part = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and part[a] != part[b] and (not sets[a] and not sets[b] or similar(sets[a], sets[b])):
                low, high = sorted((part[a], part[b]))
                part = {d: low if p == high else p for d, p in part.items()}
    return {d for d, p in part.items() if p == d}


def edited(draw: random.Random, words: list[str], n: int) -> list[str]:
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return words


def test_near_copies_equal_brute_force(spark):
    draw = random.Random(7)
    word = lambda: f"w{draw.randrange(5000)}"
    texts, chain = [], []
    for _ in range(25):
        base = [word() for _ in range(draw.choice((6, 12, 60, 200)))]
        texts += [base, *[edited(draw, base, k) for k in (1, 2, 4)]]
    # a large group around one text, a chain that is linked only step by step, and a quoted passage
    hot = [word() for _ in range(150)]
    texts += [edited(draw, hot, draw.randrange(1, 6)) for _ in range(60)]
    chain = [[word() for _ in range(120)]]
    for _ in range(12):
        chain.append(edited(draw, chain[-1], 2))
    passage = [word() for _ in range(30)]
    texts += chain + [[word() for _ in range(20)] + passage + [word() for _ in range(20)] for _ in range(60)]
    texts += [["one"], ["ONE"], [], [" "], ["a", "b"]]
    draw.shuffle(texts)
    by_id = {i: " ".join(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in by_id.items()], SCHEMA)
    kept = [r["doc_id"] for r in near.one_of_each(docs).collect()]
    assert sorted(kept) == sorted(brute_kept(by_id))


def test_an_edited_copy_goes(spark):
    base = [f"w{i}" for i in range(100)]
    copy = base[:50] + ["other"] + base[51:70] + ["words"] + base[71:]
    docs = spark.createDataFrame([(1, " ".join(base), "en", "s", 1), (2, " ".join(copy), "en", "s", 1)], SCHEMA)
    assert [r["doc_id"] for r in near.one_of_each(docs).collect()] == [1]


def test_odd_and_empty_rows(odd, clashing, empty):
    rows = near.one_of_each(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["5", "8", "None", "None"]
    assert near.one_of_each(clashing).columns == clashing.columns
    assert near.one_of_each(empty).count() == 0


def test_rows_are_judged_not_ids(spark):
    rows = [(1, "a b c", "en", "s", 1)] * 3 + [(1, "quite another text", "en", "s", 1), (None, "third text", "en", "s", 1), (None, "fourth text", "en", "s", 1), (7, "A  b C", "en", "s", 1)]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in near.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == [("1", "a b c"), ("1", "quite another text"), ("None", "fourth text"), ("None", "third text")]


def _families(draw):
    """Copies of a text with many edits, shared edits, cut ends and beginnings; one text quotes another."""
    word = lambda: f"w{draw.randrange(900)}"
    texts = []
    for _ in range(3):
        base = [word() for _ in range(60)]
        branch = edited(draw, base, 2)
        texts += [base] + [edited(draw, base, draw.randrange(1, 6)) for _ in range(25)] + [edited(draw, branch, draw.randrange(1, 4)) for _ in range(25)]
        texts += [base[: draw.randrange(40, 60)] for _ in range(6)] + [edited(draw, base[draw.randrange(4, 20) :], draw.randrange(3)) for _ in range(10)]
        texts += [base[:30] + [word() for _ in range(30)] for _ in range(5)]
    draw.shuffle(texts)
    return [" ".join(t) for t in dict.fromkeys(map(tuple, texts))]


@pytest.mark.parametrize(("small", "seed"), [(1, 1), (3, 2), (8, 3), (10**6, 4)])
def test_links_connect_what_is_similar(spark, small, seed):
    """Whatever counts as a large list, links are those of similar texts and connect all of them."""
    texts = _families(random.Random(seed))
    df = spark.createDataFrame(list(enumerate(texts)), "first long, text string")
    links = {(r["a"], r["b"]) for r in near.near_links(df, small=small).collect()}
    sets = [set(near.shingles(t).tolist()) for t in texts]
    alike = {(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    assert {(max(x), min(x)) for x in links} <= alike

    def parts(pairs):
        part = list(range(len(texts)))
        for a, b in pairs:
            old, new = sorted((part[a], part[b]))[::-1]
            part = [new if p == old else p for p in part]
        return part

    assert parts(links) == parts(alike) and len(alike) > 50


def test_candidates_of_a_large_group_grow_with_it(spark):
    """1200 edited copies of a text, most of them similar to it but not to each other: compared pairs are few for each."""
    draw = random.Random(9)
    base = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(t) for t in [base, *[edited(draw, base, draw.choice((2, 3, 3, 3, 4))) for _ in range(1200)]]]
    compared, plain = [], near._compared
    near._compared = lambda pairs, *rest: (compared.append(pairs.count()), plain(pairs, *rest))[1]
    try:
        links = near.near_links(spark.createDataFrame(list(enumerate(texts)), "first long, text string")).count()
    finally:
        near._compared = plain
    assert links >= 900 and sum(compared) < 20 * len(texts), compared


def test_simhash_gives_the_first_candidates(spark, monkeypatch):
    """Fingerprints of near copies meet first, and what they connect isn't compared again."""
    draw = random.Random(21)
    base = [f"w{draw.randrange(10**6)}" for _ in range(4000)]
    texts = [base, *[edited(draw, base, 1) for _ in range(6)], *[[f"v{draw.randrange(10**6)}" for _ in range(300)] for _ in range(5)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "first long, text string")
    bits = [near.fingerprint(near.shingles(" ".join(t))) for t in texts]
    close = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if ((bits[a] ^ bits[b]) & (2**64 - 1)).bit_count() <= 2}
    found = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in near.simhash_candidates(df).collect()}
    assert found <= close and {x for p in found for x in p} == {x for p in close for x in p} and len(found) >= 3
    compared, plain = [], near._compared
    monkeypatch.setattr(near, "_compared", lambda pairs, *rest: (compared.append((rest[-1], pairs.count())), plain(pairs, *rest))[1])
    near.near_links(df).count()
    assert compared[0][0] == "near-simhash" and compared[0][1] >= 3 and dict(compared)["near-first"] < 21


def test_bitmaps_never_tell_similar_texts_apart():
    draw = random.Random(5)
    for n in (0, 1, 31, 32, 33, 700):
        for m in (0, 1, 40, 5000):
            x, y = (np.unique(np.array([draw.randrange(-(2**63), 2**63) for _ in range(k)], "int64")) for k in (n, m))
            shared = x[: min(n, m) // 2]
            y = np.union1d(y[: m - len(shared)], shared)
            real = len(np.setxor1d(x, y))
            assert near.differing(near.bitmap(x), near.bitmap(y)) <= real and near.differing(near.bitmap(y), near.bitmap(x)) <= real
    far = [np.unique(np.array([draw.randrange(-(2**63), 2**63) for _ in range(450)], "int64")) for _ in range(2)]
    assert near.differing(*map(near.bitmap, far)) > 300


def test_a_passage_spread_over_many_tasks_is_frequent(spark, monkeypatch):
    """Unrelated texts that quote one passage, two of them in a task: none is posted under it or compared."""
    draw = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    words = lambda: [f"w{draw.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(words() + passage + words()) for _ in range(64)]
    df = spark.createDataFrame(list(enumerate(texts)), "first long, text string").repartitionByRange(32, "first")
    compared, plain = [], near._compared
    monkeypatch.setattr(near, "_compared", lambda pairs, *rest: (compared.append(pairs.count()), plain(pairs, *rest))[1])
    assert near.near_links(df).count() == 0 and sum(compared) == 0, compared


def test_copies_of_an_absent_text_meet_rarely(spark, monkeypatch):
    """Copies with so many edits that none is similar to another, their original not among them: pairs that own shingles make are few for each."""
    draw = random.Random(11)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(edited(draw, base, 9)) for _ in range(120)]
    made, plain = [], near._sifted
    monkeypatch.setattr(near, "_sifted", lambda pairs, *rest: (made.append(pairs.count()), plain(pairs, *rest))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "first long, text string")
    sets = [set(near.shingles(t).tolist()) for t in texts]
    assert max(len(a & b) / len(a | b) for a in sets for b in sets if a is not b) < 0.8
    assert near.near_links(df).count() == 0 and sum(made) < 10 * len(texts), made
