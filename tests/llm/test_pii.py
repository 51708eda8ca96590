"""Personal data beside its like."""

import random
import re

import pytest

from docgauge.llm import pii


@pytest.mark.parametrize("gap", [" ", "-", ", ", "\n"])
@pytest.mark.parametrize("card", ["4465758382889437", "4465 7583 8288 9437", "4465-7583-8288-9437", "3782 822463 10005", "4222222222222"])
def test_cards_side_by_side(card, gap):
    text = f"{card}{gap}7536784127813050{gap}{card}"
    assert [(text[s:e], kind) for s, e, kind, _ in pii.mentions(text)] == [(card, "card"), ("7536784127813050", "card"), (card, "card")]


def test_cards_beside_other_numbers():
    assert [x[3] for x in pii.mentions("12 4465758382889437 3") if x[2] == "card"] == ["4465758382889437"]
    assert [x[3] for x in pii.mentions("no 44657 58382 889 437 x") if x[2] == "card"] == ["4465758382889437"]
    assert not [x for x in pii.mentions("44657583828894371234567") if x[2] == "card"]


def test_all_names_of_a_person_are_one_entity(spark):
    text = "Blix came. Mr Zork Blix met Dr Maria Lopez. Later Zork Blix, BLIX and Maria Lopez left; Mr Blix and Lopez's car stayed, Zork too. Mr Smith knew Mr John Smith; Smith slept. Mrs Smith woke."
    found = [(text[s:e], v) for s, e, kind, v in pii.mentions(text) if kind == "person"]
    assert [v for n, v in found if "blix" in n.lower() or n == "Zork"] == ["m:Zork Blix"] * 6
    assert [v for n, v in found if "Lopez" in n] == ["f:Maria Lopez"] * 3
    assert [v for n, v in found if "Smith" in n] == ["m:John Smith"] * 3 + ["f:Smith"]
    row = pii.with_surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"k").first()
    made = {text[e["start"] : e["end"]]: e["surrogate"] for e in row["entities"]}
    assert made["Zork Blix"] == f"{made['Zork']} {made['Blix']}" and made["BLIX"] == made["Blix"].upper()
    assert made["Maria Lopez"].endswith(made["Lopez"])
    assert not any(n in row["text"] for n in ("Zork", "Blix", "BLIX", "Maria", "Lopez", "Smith"))


def brute_mentions(text):
    """Every pattern over the whole text, overlaps tried one by one."""
    found = []
    for rank, kind in enumerate(pii.TYPES[:-1]):
        for m in pii.PATTERNS[kind].finditer(text):
            value = m[0].lower() if kind == "email" else m[0] if kind == "ip" else m[0].replace(" ", "") if kind == "iban" else re.sub(r"\D", "", m[0])
            if kind == "phone" and not 7 <= len(value) <= 15 or kind == "iban" and (not 15 <= len(value) <= 34 or pii._iban_rest(value) != 1):
                continue
            found.append((rank, m.start(), m.end(), kind, value))
    found += [(pii.TYPES.index("card") + 0.5, m.start(), m.end(), "card", re.sub(r"\D", "", m[0])) for m in pii._LOOSE_CARD.finditer(text)]
    out = []
    for _, start, end, kind, value in sorted(found):
        if all(end <= s or start >= e for s, e, *_ in out):
            out.append((start, end, kind, value))
    return sorted(out)


def test_mentions_equal_brute_force(spark):
    draw = random.Random(9)
    bits = ["4465758382889437", "1.2.3.4", "10.0.0.255", "123-45-6789", "+1 (389) 555-5010", "212 555 0199", "(212) 555-0199", "a.b@c.example.org", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", " ", "  ", "-", ".", ", ", "(", ")", "+", "7", "42", "12345", "x", "at", "\n"]
    for _ in range(4000):
        text = "".join(draw.choices(bits, k=draw.randint(1, 9)))
        assert pii.mentions(text) == brute_mentions(text), repr(text)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert [x for x in pii.mentions(r["text"] or "") if x[2] != "person"] == brute_mentions(r["text"] or "")


def test_surrogates_are_one_to_one_and_can_be_taken_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    into = {}
    for r in pii.with_surrogates(docs, b"k").collect():
        text, at, back, grown = texts[r["doc_id"]], 0, [], 0
        values = {(s, e): (kind, value) for s, e, kind, value in pii.mentions(text)}
        assert {(e["start"], e["end"]) for e in r["entities"]} == set(values)
        for e in r["entities"]:
            kind, value = values[e["start"], e["end"]]
            plain = e["surrogate"].lower() if kind == "email" else e["surrogate"] if kind in ("ip", "person") else re.sub(r"[^\dA-Z]", "", e["surrogate"])
            assert into.setdefault((kind, value), plain) == plain
            start = e["start"] + grown
            back += [r["text"][at:start], text[e["start"] : e["end"]]]
            at = start + len(e["surrogate"])
            grown += len(e["surrogate"]) - (e["end"] - e["start"])
        assert "".join([*back, r["text"][at:]]) == text
    assert len({(k, s) for (k, _), s in into.items()}) == len(into) and not {(k, s) for (k, _), s in into.items()} & set(into)


def test_other_scripts_and_formats(spark):
    text = "Mr Παπαδόπουλος called 212 555 0199 from 2001:db8::8a2e:370:7334 about DE89 3704 0044 0532 0130 00."
    row = pii.with_surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"k").first()
    found = {e["type"]: e["surrogate"] for e in row["entities"]}
    assert set(found) == {"person", "phone", "ip", "iban"}
    assert all("Ͱ" <= c <= "Ͽ" for c in found["person"]) and re.fullmatch(r"\d{3} \d{3} \d{4}", found["phone"])
    assert pii._iban_rest(found["iban"].replace(" ", "")) == 1 and len(found["iban"]) == 27 and found["ip"].count(":") == 7
