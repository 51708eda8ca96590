"""Operators against brute force, round trips and the libraries themselves."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from docgauge.llm import components, decontam, lines, lmscore, packing, pii, quality, secret_scan, simhash, substrings, tokens, words
from docgauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


@pytest.fixture(scope="module")
def texts(some_documents):
    return {r["doc_id"]: r["text"] or "" for r in some_documents.collect()}


def test_token_counts_equal_the_library(spark, some_documents, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for chunk in (32_768, 40):
        for r in tokens.token_counts(some_documents, public_tokenizers.path("piece_bpe_32k.model"), chunk_chars=chunk).collect():
            assert r["n_tokens"] == len(model.encode(texts[r["doc_id"]]))
            assert r["n_bytes"] == len(texts[r["doc_id"]].encode())


def test_token_counts_on_random_texts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    machine = tokens.machine(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "the", "é", "漢", "😀", "ing", "er", "<s>", "\t", "aaaa", "▁", "0", "    ", "==", "tion", "\x00"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        for size in (3, 7, 1000):
            cut = [text[i : i + size] for i in range(0, len(text), size)] or [""]
            maps = [machine.chunk_map(c, i == 0, i == len(cut) - 1) for i, c in enumerate(cut)]
            assert machine.scan(maps) == len(model.encode(text)), repr(text)


def test_packing_is_gapless_and_best_fit(spark, some_documents, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = QUERIES["op1_best_fit_packing"](spark, SF).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    lengths = []
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in pieces] == [(i, len(ids[i : i + 2048])) for i in range(0, len(ids), 2048)]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in pieces)
        lengths += [r["length"] for r in pieces]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) == best_fit_decreasing(lengths, 2048)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        gap = min(fitting) if fitting else capacity
        if fitting:
            gaps.remove(gap)
        gaps.append(gap - length)
    return len(gaps)


def test_best_fit_plan():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([8, 20, 64])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 300)))
        used = set()
        for length, _, first, each, offset in packing.best_fit_plan(counts, capacity):
            assert offset + each * length <= capacity
            used.add(first)
        opened = best_fit_decreasing(list(counts.elements()), capacity)
        assert max(used, default=-1) < opened


def test_encoder_on_random_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    rng = random.Random(3)
    parts = [" ", "\n", "the", "é", "é", "漢", "😀", "ΑΣ", "İ", "<|endoftext|>", "\x1c", "\x85", "\xa0", "12", "²", "'s", "'LL", "_", "　"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 20)))
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def brute_repeats(texts, length):
    seen, out = set(), {}
    for doc in sorted(texts):
        row = split(texts[doc])
        gone = set()
        for i in range(len(row) - length + 1):
            window = tuple(row[i : i + length])
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        out[doc] = " ".join(w for i, w in enumerate(row) if i not in gone)
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(4)
    passage = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)]
    texts = {}
    for doc in range(60):
        row = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 80))]
        if doc % 2:
            at, a, b = rng.randint(0, len(row)), rng.randint(0, 20), rng.randint(30, 60)
            row[at:at] = passage[a:b]
        if doc % 9 == 0:
            row = ["x", "y"] * 40
        texts[doc] = rng.choice([" ", "\n", "\t "]).join(row)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute_repeats(texts, 20)
    for group in (10**6, 150, 20):
        found = {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs, 20, group).collect()}
        assert found == expected
    twice = substrings.without_repeats(docs.union(docs), 20, 150).collect()
    assert len(twice) == 2 * len(expected) and all(r["text"] == expected[r["doc_id"]] for r in twice)


def test_groups_are_small_and_cover_all_paths(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(("the", "the", "of", *"abcdefgh")) for _ in range(200))) for i in range(50)] + [(i, "same " * 60) for i in range(50, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(10)
    bounds = substrings.group_bounds(docs, 20, 300)
    dealt = substrings._suffixes(docs, 20, bounds).groupBy("task").agg((F.sum(F.length("path")) / 8).alias("n")).collect()
    assert bounds == sorted(bounds) and len(bounds) > 10
    assert {r["task"] for r in dealt} <= set(range(len(bounds))) and max(r["n"] for r in dealt) < 600


def test_window_hashes_match_equal_windows_only():
    rng = random.Random(5)
    codes = np.array([rng.getrandbits(64) for _ in range(40)], np.uint64)
    for size in (1, 2, 3, 5, 8, 13, 20):
        hashes = words.window_hashes(codes, size)
        assert all(words.window_hashes(codes[i : i + size], size)[0] == h for i, h in enumerate(hashes))
        assert len(set(hashes.tolist())) == len(hashes)


def test_word_codes(texts):
    rows = [t.encode() for t in texts.values()] + [b"", b" ", b"x" * 600_000 + b" y " + b"z " * 400_000, "\x0b\x0cé\x85".encode()]
    codes, sizes = words.batch_codes(rows)
    assert sizes.tolist() == [len(r.split()) for r in rows]
    assert np.array_equal(codes, np.concatenate([words.word_codes(r) for r in rows]))
    known = {}
    for code, word in zip(codes.tolist(), [w for r in rows for w in r.split()], strict=True):
        assert known.setdefault(word, code) == code
    assert len(set(known.values())) == len(known)


def brute_base(text):
    row = split(text)
    windows = list(zip(row, row[1:], row[2:]))
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    found = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(row), sum(map(len, row)), sum(c in "#*$%&|<>" for c in text), len(found) - len(set(found)), len(covered))


def test_quality_base_and_verdict(spark, some_documents, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality.quality(some_documents).collect()
    right = total = 0
    for r in rows:
        base = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] in labels and not r["base_failed"]:
            total += 1
            right += r["kept"] == bool(labels[r["doc_id"]])
    assert right >= 0.95 * total


def test_quality_runs_no_python(some_documents):
    plan = quality.features(some_documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_fingerprint(text):
    row = [w.decode() for w in text.encode().lower().split()]
    shingles = [" ".join(row[i : i + 3]) for i in range(max(1, len(row) - 2))] if row else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(fingerprints):
    group = {i: i for i in fingerprints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in fingerprints:
        for j in fingerprints:
            if i < j and (fingerprints[i] ^ fingerprints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {i: root(i) for i in group}


def test_simhash_equals_brute_force(some_documents, texts):
    expected = {doc: brute_fingerprint(t) for doc, t in texts.items()}
    component = classes(expected)
    for r in simhash.near_duplicates(some_documents).collect():
        assert int(r["fingerprint"], 16) == expected[r["doc_id"]]
        assert r["component_id"] == component[r["doc_id"]]


def test_links_lose_nothing_in_hot_postings(spark):
    rng = random.Random(6)
    base, made = rng.getrandbits(64), set()
    for _ in range(150):
        x = base
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randint(0, 40)
        made.add(x)
    for x in list(made)[:60]:
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randint(0, 63)
        made.add(x)
    fingerprints = dict(enumerate(made))
    signed = [(v - 2**64 if v >= 2**63 else v, i) for i, v in fingerprints.items()]
    distinct = spark.createDataFrame(signed, "fingerprint long, first long")
    expected = classes(fingerprints)
    for small in (2, 10**6):
        found = {r["node"]: r["component"] for r in components.components(simhash.links(distinct, small)).collect()}
        assert {i: found.get(i, i) for i in fingerprints} == expected


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and all(found[100 + i] == 100 for i in range(1, 40))


def test_surrogates(spark):
    text = "Mail Bob.Smith@Mail7.Example.com, +1 (389) 555-5010 or +1 389-555-5010, 152.143.123.131, 4111 1111 1111 1111, Mrs Smith, г-жа Иванова."
    docs = spark.createDataFrame([(1, text), (2, "again bob.smith@mail7.example.com"), (3, "nothing here, 2024")], "doc_id long, text string")
    made = {r["doc_id"]: r for r in pii.with_surrogates(docs, b"secret").collect()}
    assert made[3]["text"] == "nothing here, 2024" and made[3]["entities"] == []
    found = {e["type"]: e["surrogate"] for e in made[1]["entities"]}
    assert set(found) == {"email", "phone", "ip", "card", "person"}
    assert pii._luhn("".join(c for c in found["card"] if c.isdigit())) == 0 and len(found["card"]) == 19
    assert made[2]["entities"][0]["surrogate"] == found["email"].lower()
    for e in made[1]["entities"]:
        assert text[e["start"] : e["end"]] not in made[1]["text"]
    phones = [e["surrogate"] for e in made[1]["entities"] if e["type"] == "phone"]
    assert phones[0].replace("(", "").replace(") ", "-")[-12:] == phones[1][-12:]
    people = [e["surrogate"] for e in made[1]["entities"] if e["type"] == "person"]
    assert people[0].isascii() and people[1].endswith("а") and people[1].startswith(pii.SYLLABLES["cyrillic"][0])


def test_surrogates_are_distinct(spark, monkeypatch):
    names = [f"m:John {a}{b}" for a in "ABCDEFGHIJ" for b in ("aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh", "ii", "jj") for _ in range(1)]
    # what two of them would get is the name of others
    names += [f"m:{pii.surrogate(b'k', 'person', n, 0, pii.name_parts(len(names) + 2))}" for n in names[:2]]
    found = spark.createDataFrame([("person", n) for n in names], "type string, value string")
    made = pii.attempts(found, b"k").collect()
    assert len({r["surrogate"] for r in made}) == len(names) == len(made)
    assert any(r["attempt"] > 0 for r in made)
    text = spark.createDataFrame([(i, f"Mr {n[2:]} spoke") for i, n in enumerate(names)], "doc_id long, text string")
    few = {r["doc_id"]: r["text"] for r in pii.with_surrogates(text, b"k").collect()}
    monkeypatch.setattr(pii, "BROADCAST_VALUES", 0)
    assert {r["doc_id"]: r["text"] for r in pii.with_surrogates(text, b"k").collect()} == few
    assert len(set(few.values())) == len(names)


def brute_spans(text):
    import re

    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0]))))


def test_open_secrets(spark, texts):
    for r in QUERIES["op7_secret_scan"](spark, SF).collect():
        assert r["base_sha256"] == hashlib.sha256(brute_spans(texts[r["doc_id"]]).encode()).hexdigest()


def test_wrapped_secrets():
    secret = 'password = "hunter22secret"'
    plain = base64.b64encode(secret.encode()).decode()
    percent = "".join(f"%{c:02x}" for c in secret.encode())
    wrapped = {
        "base64": plain,
        "base64>base64": base64.b64encode(plain.encode()).decode(),
        "base64>compressed": base64.b64encode(gzip.compress(secret.encode())).decode(),
        "url": percent,
        "url>url": percent.replace("%", "%25"),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in secret),
    }
    for layers, text in wrapped.items():
        start = len("before é ")
        ((kind, found, s, e),) = secret_scan.all_spans(f"before é {text} after")
        assert (kind, found) == ("assign", layers) and start <= s < e <= start + len(text)
    assert secret_scan.all_spans("%25" * 50) == []


def test_template_matches(spark):
    item = "If Anna has 12 apples and walks 5 km to the market, how many apples can Tom buy for 30 dollars there?"
    other = "If Maria has 99 apples and walks 7 miles to the market, how many apples can Peter buy for 45 euros there?"
    mixed = "If Maria has 99 apples and walks 7 miles to a park. Nobody knows how many birds she saw on that day or the next."
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "short one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Some words. {other} More words."), (2, mixed), (3, None), (4, item.upper())], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()}
    assert (1, 1) in found and not any(d in (2, 3) for d, _ in found)


def test_inconsistent_slots_do_not_match(spark):
    item = "Take 4 red balls and then 4 blue balls and then 4 green balls, so 4 of each kind in the box."
    same = item.replace("4", "9")
    odd = "Take 1 red balls and then 2 blue balls and then 3 green balls, so 5 of each kind in the box."
    docs = spark.createDataFrame([(1, same), (2, odd)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()] == [(1, 7)]


def test_items_of_slots_or_few_words_are_found(spark):
    items = [(1, "12 + 7 - 3 = 16 and 4 + 5 = 9"), (2, "short five word item"), (3, "Anna Berg und Hans Weber wohnen in Bonn"), (4, "..."), (5, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, f"Before it, {t} and after.") for i, t in items] + [(11, items[0][1]), (12, items[1][1]), (13, "13 + 7 - 3 = 17 and 4 + 5 = 9"), (14, items[2][1].lower()), (15, "a short five letter item"), (16, None)]
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert found == {(1, 1), (2, 2), (3, 3), (11, 1), (12, 2), (14, 3)}


def test_slots_go_together_one_to_one(spark):
    item = "A car drives at 60 mph from the town to the lake which is 120 miles away from it"
    merged = item.replace("60", "75").replace("120", "75")
    swapped = item.replace("60", "75").replace("120", "150")
    docs = spark.createDataFrame([(1, merged), (2, swapped)], "doc_id long, text string")
    found = {r["doc_id"]: r["share"] for r in decontam.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"), min_share=0.1).collect()}
    assert found[2] == 1.0 and found[1] < 1.0


def test_short_items_count_as_whole_lines_only(spark):
    rows = [(1, "the", "en"), (2, "some words and the others", "en"), (3, "first line here\n  The...\nlast", "en"), (4, None, None), (5, "Two  words", "x"), (6, "yes and no\n\n...", "en"), (7, "!!! " * 9 + "yes", "en"), (8, "two words more", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    benchmark = spark.createDataFrame([(1, "the"), (2, "yes"), (3, "two\nwords"), (4, None), (5, "...")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.clean_documents(docs, benchmark).collect()) == [2, 4, 6, 8]
    assert {r["form"] for r in decontam.contaminated(docs, benchmark).collect()} == {"short"}
    assert decontam.clean_documents(docs, benchmark.limit(0)).count() == len(rows)


def test_scattered_windows_are_no_match(spark):
    item = "when the long train had left the old station the two brothers walked home along the dark river and spoke no word"
    row = item.split()
    scattered = " ".join(" ".join(row[i : i + 6]) + " " + " ".join(f"x{i}y{k}" for k in range(30)) for i in range(0, len(row), 2))
    near = " ".join([*row[:11], "then", "slowly", *row[11:]])
    odd = item.replace("two", "3")
    docs = spark.createDataFrame([(1, scattered), (2, near), (3, item), (4, odd)], "doc_id long, text string")
    found = [r["doc_id"] for r in decontam.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"), min_share=0.7).collect()]
    assert sorted(found) == [2, 3, 4] and len(decontam.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()) >= 1


def brute_contaminated(texts, items):
    """All alignments of all documents and items, window by window."""
    templates, out = decontam.Templates(), set()
    forms = lambda t: {kind: [(h, at, v) for h, at, form, v in templates.windows(t, 5) if (form > 0) == kind] for kind in (False, True)}
    for item, t in items.items():
        mine = forms(t)
        for doc, d in texts.items():
            other = forms(d)
            for kind in (False, True):
                windows = {h for h, *_ in mine[kind]}
                matches = {(p - q, h, tuple(zip(v, w))) for h, q, v in mine[kind] for g, p, w in other[kind] if g == h}
                drift = max(1, len(windows) // 5)
                for shift in {s for s, *_ in matches}:
                    near = [m for m in matches if shift <= m[0] <= shift + drift]
                    met = Counter(p for *_, pairs in near for p in pairs)
                    into = {a: min(b for (x, b), n in met.items() if x == a and n == max(k for (y, _), k in met.items() if y == a)) for (a, _) in met}
                    if windows and len({h for _, h, pairs in near if all(into[a] == b for a, b in pairs)}) >= 0.8 * len(windows):
                        out.add((doc, item))
    return out


def test_decontamination_equals_brute_force(spark, some_documents, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(40).collect()}
    some = dict(list(texts.items())[:120])
    for n, t in enumerate(list(items.values())[:20]):
        row = t.split()
        some[10_000 + n] = " ".join([*row[: n % 7], *(["extra"] * (n % 3)), *row[n % 7 :]])
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()}
    assert found and found == brute_contaminated(some, items)


def test_decontamination_paths_agree(spark, some_documents, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    few = sorted(map(tuple, decontam.contaminated(some_documents, benchmark).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert few and sorted(map(tuple, decontam.contaminated(some_documents, benchmark).collect())) == few


def test_scores_do_not_depend_on_blocks(spark, some_documents):
    rows = [{r["doc_id"]: (r["n_words"], round(r["log_score"], 6), r["n_backed_off"]) for r in lmscore.backoff_scores(some_documents, block_bytes=b).collect()} for b in (10**9, 20_000)]
    assert rows[0] == rows[1]


def test_line_marks_do_not_depend_on_partitions(spark, some_documents):
    hashed = lines.line_hashes(some_documents).cache()
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, lines.repeated_lines(hashed).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    first = hashed.groupBy("high", "low").agg(F.min("doc").alias("first"))
    expected = sorted(map(tuple, hashed.join(first, ["high", "low"]).filter("doc > first").select("doc", "position").collect()))
    assert found[0] == found[1] == expected
