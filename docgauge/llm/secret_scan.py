"""Secrets in texts and in what texts encode.

Each text starts a worklist of layers.  A layer is scanned for secrets, then unwrapped:
percent and Unicode escapes are decoded over the whole layer, base64 segments (also ones
that are wrapped over lines, stand in a path, or hold gzip, zlib, bzip2 or xz data) one by
one; each new layer joins the worklist until none is new.  An escape mark that is itself
escaped many times over (%25252541) is peeled to its last escape in one step, so depth costs
no layers.  Compressed data is unfolded as a stream and enters in parts, each of which ends
where no word and no run of base64 lines goes on, so that only a single token of great length
needs memory of its size.  A layer that equals one around it is not
entered, so cycles end; one that repeats at another place is.
Every layer carries a map of its characters to the text, through which its spans are
reported; a span counts for the layer only if decoding had a part in it.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.stage import whole_text

#: The base kinds in their order.
KINDS = ("assign", "access", "hex")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")

_NEXT = "%[89AB][0-9A-F]"
#: Runs of whole UTF-8 characters (bytes that are none stay as they stand), or a percent sign escaped so often that it stays escaped.
_PERCENT = re.compile(
    f"%(?:25)+(?=25[0-9A-F]{{2}})|(?:%(?!2525[0-9A-F]{{2}})[0-7][0-9A-F]|%(?:C[2-9A-F]|D[0-9A-F]){_NEXT}|%E0%[AB][0-9A-F]{_NEXT}|%E[1-9A-CEF](?:{_NEXT}){{2}}|%ED%[89][0-9A-F]{_NEXT}"
    f"|%F0%[9AB][0-9A-F](?:{_NEXT}){{2}}|%F[1-3](?:{_NEXT}){{3}}|%F4%8[0-9A-F](?:{_NEXT}){{2}})+",
    re.IGNORECASE | re.ASCII,
)
_SLASH, _AMP = r"(?:u005c|U0000005c|u\{0*5c\}|x5c)", r"(?:#0*38;|#x0*26;)"
_SLASHES, _AMPS = (re.compile(x, re.IGNORECASE | re.ASCII) for x in (rf"\\{_SLASH}+", f"&{_AMP}+"))
#: Runs of escapes, or a mark escaped so often that it stays escaped.
_UNICODE = re.compile(rf"\\(?i:{_SLASH})+(?=(?i:{_SLASH})[uUx])|&(?i:{_AMP})+(?=(?i:{_AMP})#)|" r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)+")
_ESCAPE = re.compile(r"\\[uU]\{?([0-9A-Fa-f]+)\}?|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]+);|&#([0-9]+);")
_BASE64 = re.compile("[A-Za-z0-9+/_-]{16,}={0,2}")
_NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})(?=[ \t]*\r?(?:\n|\Z))")
_PATH_MARK = re.compile("[/_-]")
#: Bytes that unfolded data is taken in; a part ends where nothing is open, whatever its length.
PART_BYTES = 4 * 2**20
#: A word behind another one of its line, or a character that a line of base64 doesn't hold: what stands before can't be continued.
_BREAK = re.compile(r"\S[ \t]+(?=\S)|[^A-Za-z0-9+/_=\s-]")
#: Words before a break that may be the beginning of an assignment: a name, a sign and a quote.
_WORDS_BEFORE = 3


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the secrets that stand openly in text, kind by kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _replaced(text: str, pattern: re.Pattern, decode) -> tuple[str, np.ndarray, np.ndarray, np.ndarray] | None:
    """text with decoded matches; per new character its start and end in text, and whether it was decoded."""
    out, starts, ends, new, at = [], [], [], [], 0
    for m in pattern.finditer(text):
        if (made := decode(m[0])) is None:
            continue
        s, e = m.span()
        out += [text[at:s], made]
        plain = np.arange(at, s)
        starts += [plain, np.full(len(made), s)]
        ends += [plain + 1, np.full(len(made), e)]
        new += [np.zeros(s - at, bool), np.ones(len(made), bool)]
        at = e
    if not out:
        return None
    plain = np.arange(at, len(text))
    return "".join([*out, text[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1]), np.concatenate([*new, np.zeros(len(plain), bool)])


def _percent(run: str) -> str:
    if run.count("%") == 1 and len(run) > 3:
        return "%"
    return bytes.fromhex(run.replace("%", "")).decode()


def _escapes(run: str) -> str:
    """Escapes that stand for no character become U+FFFD, the others are decoded; a mark that is escaped many times is peeled."""
    if _SLASHES.fullmatch(run) or _AMPS.fullmatch(run):
        return run[0]
    codes = [int(a or b or c, 16) if (a or b or c) else int(d) for a, b, c, d in _ESCAPE.findall(run)]
    codes = [c if c < 0x110000 else 0xFFFD for c in codes]
    return b"".join(c.to_bytes(2, "little") if c < 0x10000 else chr(c).encode("utf-16-le") for c in codes).decode("utf-16-le", errors="replace")


def _machine(data: bytes):
    """A decompressor for what data begins like, and how to feed it at most so many bytes out."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _unfolded(data: bytes) -> Iterator[bytes]:
    """What compressed data holds, in parts; raises where it is broken."""
    machine, left = _machine(data), data
    while not machine.eof:
        made = machine.decompress(left, PART_BYTES)
        left = getattr(machine, "unconsumed_tail", b"")
        if made:
            yield made
        elif not left and not machine.eof and getattr(machine, "needs_input", True):
            raise EOFError


def _texts(data: bytes) -> Iterator[tuple[str, str]] | None:
    """Layer names behind base64, and texts, of data that holds text, plain or compressed (also several times); None where it holds none."""
    if _machine(data) is None:
        try:
            made = data.decode()
        except UnicodeDecodeError:
            return None
        return iter([("", made)]) if made else None
    try:
        for _ in _decoded(_unfolded(data)):  # a first pass tells whether all of it is whole text
            pass
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return None
    except UnicodeDecodeError:
        # Data in data is small in memory only if it is taken whole; its own parts are streamed again.
        try:
            inner = _texts(b"".join(_unfolded(data))) if _machine(next(_unfolded(data))) else None
        except StopIteration:
            return None
        return ((f">compressed{name}", t) for name, t in inner) if inner else None
    return ((">compressed", t) for t in _decoded(_unfolded(data)))


def _open_from(text: str) -> int:
    """Where the last word begins that what follows may continue (base64 goes on over lines), with some words before it; 0 if all of text may be continued."""
    size = 1 << 12
    while True:  # from the end, as breaks are near it in most texts
        low = max(0, len(text) - size)
        last = None
        for last in _BREAK.finditer(text, low):
            pass
        if last or not low:
            break
        size *= 8
    if not last:
        return 0
    at = last.end() if last[0][-1].isspace() else _word_start(text, last.start())
    for _ in range(_WORDS_BEFORE):
        before = at
        while before and text[before - 1].isspace():
            before -= 1
        at = _word_start(text, before)
    return at


def _word_start(text: str, at: int) -> int:
    return max(text.rfind(c, 0, at) for c in " \n\t\r") + 1


def _decoded(parts: Iterator[bytes]) -> Iterator[str]:
    """Texts of a stream of bytes; none ends in a word or a run of lines that goes on."""
    machine, held = codecs.getincrementaldecoder("utf-8")(), []
    for part in parts:
        made = machine.decode(part)
        at = _open_from(made)
        if at:
            yield "".join([*held, made[:at]])
            held = []
        held.append(made[at:])
    machine.decode(b"", True)
    if rest := "".join(held):
        yield rest


def _base64(segment: str) -> Iterator[tuple[str, str]] | None:
    """Layer names and texts of a base64 segment that holds text, plain or compressed."""
    bare = segment.rstrip("=")
    if len(bare) % 4 == 1:
        return None
    try:
        data = base64.b64decode(bare.translate({45: "+", 95: "/"}) + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None
    made = _texts(data)
    return ((f"base64{name}", t) for name, t in made) if made else None


def _segments(layer: str) -> Iterator[tuple[int, int, Iterator[tuple[str, str]]]]:
    """start, end, texts of base64 segments; one that is none as a whole is tried part by part, as in a path."""
    for m in _BASE64.finditer(layer):
        if got := _base64(m[0]):
            yield *m.span(), got
            continue
        at = m.start()
        for part in _PATH_MARK.split(m[0]):
            if len(part) >= 16 and len(part) < len(m[0]) and (got := _base64(part)):
                yield at, at + len(part), got
            at += len(part) + 1


def _wrapped(layer: str) -> Iterator[tuple[int, int, Iterator[tuple[str, str]]]]:
    """start, end, decoded of base64 that is wrapped over lines of one width, the last at most as long.

    A word above or below the block may look like a line of it, so both are also tried without.
    """
    done = 0
    for m in _BASE64.finditer(layer):
        if m.start() < done or m[0].endswith("="):
            continue
        chain = [m.span()]
        while more := _NEXT_LINE.match(layer, chain[-1][1]):
            width = chain[-1][1] - chain[-1][0]
            if len(chain) > 2 and more.end(1) - more.start(1) > width:
                break
            chain.append(more.span(1))
            if more[1].endswith("=") or len(chain) > 2 and more.end(1) - more.start(1) < width:
                break
        for low, high in ((0, 0), (0, 1), (1, 0), (1, 1)):
            part = chain[low : len(chain) - high]
            if len(part) > 1 and (got := _base64("".join(layer[s:e] for s, e in part))):
                yield part[0][0], part[-1][1], got
                break
        if len(chain) > 2:
            done = chain[-1][0]


def _inner(layer: str) -> Iterator[tuple[str, str, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Text, name, and per character start and end in layer, and whether decoding had a part (None: in all), of the layers in a layer."""
    for mark, name, pattern, decode in (("%", "url", _PERCENT, _percent), ("", "unicode", _UNICODE, _escapes)):
        if (mark in layer if mark else "\\" in layer or "&#" in layer) and (got := _replaced(layer, pattern, decode)):
            yield got[0], name, *got[1:]
    for start, end, texts in (*_segments(layer), *_wrapped(layer)):
        for name, made in texts:
            yield made, name, np.full(len(made), start), np.full(len(made), end), None


def all_spans(text: str) -> list[tuple[str, str, int, int]]:
    """kind, layers (empty: open), start, end in code points of text, sorted."""
    found = {(kind, "", s, e) for kind, s, e in base_spans(text)}
    seen = set()
    # The worklist: a layer's names, start and end in text of each character (None: the same), from where decoding had a part,
    # the layers around it and itself, and those in it that are left.
    work = [("", None, None, None, (text,), _inner(text))]
    while work:
        names, starts, ends, new, around, left = work[-1]
        step = next(left, None)
        if step is None:
            work.pop()
            continue
        inner, name, s, e, fresh = step
        if not inner or inner in around:
            continue
        at, to = (s, e) if starts is None else (starts[s], ends[e - 1])
        place = hashlib.blake2b(inner.encode(errors="surrogatepass") + b"\0" + at.tobytes() + to.tobytes(), digest_size=16).digest()
        if place in seen:
            continue
        seen.add(place)
        name = f"{names}>{name}" if names else name
        if fresh is not None and new is not None and len(s):
            fresh = fresh | np.maximum.reduceat(np.r_[new, False], s)[: len(s)]
        for kind, a, b in base_spans(inner):
            if fresh is None or fresh[a:b].any():
                found.add((kind, name, int(at[a]), int(to[b - 1])))
        work.append((name, at, to, fresh, (*around, inner), _inner(inner)))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[2], x[1] != "", rank[x[0]], x[3], x[1]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, layers, start, end, in order of start) for every row of docs.

    layers is empty for secrets that stand openly and names the decodings otherwise, outermost
    first, as in ``base64>url``.  A null or empty text has no spans; very long texts are
    scanned whole; of spans with one start open ones come first, then kinds in their order.  A
    null doc_id stays null; repeated rows give a row each; an empty table gives no rows; other
    columns are ignored.
    """

    @F.pandas_udf("array<struct<kind: string, layers: string, start: int, end: int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[dict(zip(("kind", "layers", "start", "end"), x, strict=True)) for x in all_spans(t)] for t in b], dtype=object)

    return docs.select("doc_id", spans(whole_text()).alias("spans"))
