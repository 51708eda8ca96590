"""Secrets in layers that repeat, hold odd characters or are wrapped."""

import base64
import zlib

import pytest

from docgauge.llm import secret_scan
from docgauge.llm.secret_scan import all_spans


def _b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def test_every_copy_of_a_segment_is_found():
    for data in (b"password = hunter2secret", zlib.compress(b"password = hunter2secret " * 3)):
        segment = _b64(data)
        text = f"a {segment} b {segment} c"
        first, second = text.index(segment), text.rindex(segment)
        assert {(s, e) for _, names, s, e in all_spans(text) if names} == {(first, first + len(segment)), (second, second + len(segment))}
    inner = _b64(_b64(b"token: abcdef123456").encode())
    assert len({s for _, names, s, _ in all_spans(f"{inner} {inner}") if names == "base64>base64"}) == 2


def test_layers_with_unprintable_characters():
    for data in ("\ufeffpassword = hunter2secret", "mot\u00a0de passe\u200d\x0c password = hunter2secret"):
        assert [x[:2] for x in all_spans(_b64(data.encode()))] == [("assign", "base64")]


def test_percent_runs_are_decoded_piece_by_piece():
    run = "%FF" + "".join(f"%{c:02X}" for c in b"password=hunter2x") + "%C3"
    assert all_spans(run) == [("assign", "url", 3, len(run) - 3)]
    assert all_spans("%e2%82%acpassword=hunter2x")[0][:2] == ("assign", "")


def test_wrapped_base64_is_joined():
    whole = _b64(zlib.compress(b"".join(b"%d line\n" % (i * i * 7919) for i in range(60)) + b"password = hunter2secret"))
    for end in ("\n", "\r\n"):
        block = end.join(whole[i : i + 76] for i in range(0, len(whole), 76))
        for text in (block, f"see\n{block}\nend of it", f"Internationalization{end}{block}{end}word"):
            at = text.index(block)
            assert ("assign", "base64>compressed", at, at + len(block)) in all_spans(text)


def test_deep_escapes_and_long_layers_are_quick():
    import time

    began = time.time()
    for text, layers in (
        ("pass%" + "25" * 330_000 + "77ord=hunter2secret", "url>url>url"),
        ("pass\\u005c" + "u005c" * 150_000 + "u0077ord=hunter2secret", "unicode>unicode>unicode"),
        ("pass&#38;" + "#38;" * 200_000 + "#119;ord=hunter2secret", "unicode>unicode>unicode"),
    ):
        assert ("assign", layers, 0, len(text)) in all_spans(text)
    segment = _b64(zlib.compress(b"x y " * 20_000_000 + b" password = hunter2secret " + b"z z " * 100))
    assert ("assign", "base64>compressed", 4, 4 + len(segment)) in all_spans(f"see {segment} end")
    assert time.time() - began < 60


def test_base64_in_a_path():
    segment = _b64(b"password = hunter2secret").rstrip("=")
    text = f"https://h.example.org/a/{segment}/b"
    at = text.index(segment)
    assert all_spans(text) == [("assign", "base64", at, at + len(segment))]
    inner = _b64(zlib.compress(zlib.compress(b"password = hunter2secret")))
    assert all_spans(inner) == [("assign", "base64>compressed>compressed", 0, len(inner))]


def test_layers_equal_a_plain_worklist():
    """Random nestings of the encodings against a worklist that decodes whole texts only and knows no places."""
    import random
    import urllib.parse

    draw = random.Random(3)
    wrap = {
        "url": lambda t: "".join(f"%{c:02x}" for c in t.encode()),
        "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        "base64": lambda t: _b64(t.encode()),
        "base64>compressed": lambda t: _b64(zlib.compress(t.encode())),
    }
    back = {"url": urllib.parse.unquote, "unicode": lambda t: t.encode().decode("unicode_escape")}
    for _ in range(60):
        text, names = "password=hunter2secret", []
        for _ in range(draw.randint(1, 4)):
            kind = draw.choice(list(wrap))
            text, names = wrap[kind](text), [kind, *names]
        plain, layers = text, list(names)
        while layers:  # the plain worklist
            kind = layers.pop(0)
            data = back[kind](plain) if kind in back else __import__("base64").b64decode(plain)
            plain = zlib.decompress(data).decode() if kind.endswith("compressed") else data.decode() if isinstance(data, bytes) else data
        assert plain == "password=hunter2secret"
        found = {x for x in all_spans(f"a {text} b") if x[0] == "assign"}
        assert ("assign", ">".join(names), 2, 2 + len(text)) in found


@pytest.mark.parametrize("wrapped", [False, True])
def test_long_layers_across_parts(spark, wrapped, monkeypatch):
    """A layer of many parts' length inside compressed data is found wherever it lies."""
    monkeypatch.setattr(secret_scan, "PART_BYTES", 1000)
    for size in (40, 900, 5000):
        inner = base64.b64encode(("filler words here " * size)[:size].encode() + b" password: hunter2hunter2 " + b"more of it " * 20).decode()
        if wrapped:
            inner = "\n".join(inner[i : i + 76] for i in range(0, len(inner), 76))
        for offset in (0, 1, 500, 880, *range(975, 1003, 3), 1500):
            text = ("some words of prose. " * 200)[:offset] + "\n" + inner + "\nand more prose. " * 9
            found = [t for t in secret_scan._decoded(iter([text[i : i + 1000].encode() for i in range(0, len(text), 1000)]))]
            assert "".join(found) == text and any(inner in t for t in found), (size, offset)
            blob = base64.b64encode(zlib.compress(text.encode(), 9)).decode()
            spans = secret_scan.find_secrets(spark.createDataFrame([(1, blob)], "doc_id long, text string")).first()["spans"] if offset in (0, 984) else None
            assert spans is None or any(s["kind"] == "assign" for s in spans), (size, offset)


def test_assignments_across_parts():
    text = "filler text. " * 60 + "password" + " " * 700 + "=" + " " * 300 + '"hunter2hunter2" ' + "more text. " * 60
    for size in range(300, 1400, 37):
        parts = list(secret_scan._decoded(iter([text[i : i + size].encode() for i in range(0, len(text), size)])))
        assert "".join(parts) == text and sum(len([s for s in secret_scan.base_spans(t) if s[0] == "assign"]) for t in parts) == 1


def test_a_layer_of_megabytes_across_a_part():
    """133 kB and 5 MB of base64 across the end of the first part, at its real size."""
    for size in (100_000, 5_000_000):
        inner = base64.b64encode(b"x " * (size // 2) + b"password: hunter2hunter2").decode()
        for before in (secret_scan.PART_BYTES - 50, secret_scan.PART_BYTES - 70_000, secret_scan.PART_BYTES - 3):
            text = ("word " * (before // 5 + 1))[: before - 1] + "\n" + inner + "\nend of it."
            data = zlib.compress(text.encode(), 1)
            assert any(inner in t for _, t in secret_scan._texts(data))
