"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

1. Documents are scanned in place for mentions.  A mention has a type and a value that is
   free of its format (an address in lower case, the digits of a number, a name's words),
   so that all mentions of one entity share a value; their different values are gathered.
2. A surrogate is drawn by a keyed hash of type, value and attempt: nobody can undo it
   without the key, and an entity has the same surrogate in every document.  Names are put
   together from syllables, in as many parts as the number of entities calls for, so that
   at most one draw in ``ROOM`` collides and few rounds are needed.  Collisions
   are checked over the whole corpus: two values of a type with one surrogate, or a
   surrogate that is itself a value found in the corpus, send the later value to its next
   attempt, until all surrogates are distinct.
3. Documents are scanned again and rewritten; each mention's format is kept.  Only values
   that needed another attempt must be looked up.  Up to ``BROADCAST_VALUES`` of them are
   broadcast; more are joined by document.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.stage import doc_key, free_name, stored, whole_text

TYPES = ("email", "ip", "iban", "card", "ssn", "phone", "person")
BROADCAST_VALUES = 100_000
#: Surrogate names that there are for each entity at least.
ROOM = 64

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: How the types are written.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "ip": re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<!\d)(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "phone": re.compile(r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<!\d )\d{3} \d{3} \d{4}(?! \d))(?!\d)"),
}
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")
#: What a match of ip, card, ssn or phone lies in.
_NUMERIC = re.compile(r"[+(]?\d[\d() .-]{5,}\d")
#: Cards in groups of another layout, with no number beside them; they yield to those of PATTERNS.
_LOOSE_CARD = re.compile(r"(?<!\d)(?<!\d[ -])\d(?:[ -]?\d){12,18}(?![ -]?\d)")
#: Titles that lead a name, by gender (x: either).
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Mme", "Madame", "Mlle", "Frau", "Sra", "Señora", "Srta", "г-жа", "госпожа"),
    "m": ("Mr", "Monsieur", "Herr", "Sr", "Señor", "г-н", "господин"),
    "x": ("Dr", "Prof", "Professor"),
}
#: Surrogate given names by script and gender.
GIVEN = {
    ("latin", "f"): ("Alice", "Anna", "Beatrice", "Clara", "Diana", "Elena", "Eva", "Greta", "Helen", "Ida", "Julia", "Laura", "Maria", "Nina", "Rosa", "Sofia"),
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "George", "Hugo", "Ivan", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Юрий"),
}
#: Beginnings, middles and ends of surrogate family names by script.
SYLLABLES = {
    "latin": (
        ("Bar", "Bel", "Cal", "Cor", "Dal", "Dor", "Fal", "Fen", "Gar", "Hal", "Har", "Kel", "Lan", "Mar", "Mer", "Nor", "Pel", "Ram", "Ros", "Sal", "Tor", "Val", "Ver", "Wil"),
        ("a", "ba", "de", "di", "e", "i", "la", "le", "li", "mo", "ne", "o"),
        ("bert", "dan", "der", "feld", "gard", "gren", "land", "mann", "mond", "nell", "ner", "quist", "rand", "rell", "rick", "sen", "ser", "stad", "ston", "tano", "ter", "vale", "well", "wick"),
    ),
    "cyrillic": (
        ("Бар", "Бел", "Вар", "Вол", "Гор", "Дар", "Дол", "Жар", "Зим", "Кол", "Кор", "Лар", "Мор", "Пол", "Рад", "Сол", "Тар", "Яр"),
        ("а", "и", "о", "у", "ам", "ин", "ос", "ут"),
        ("дов", "ков", "лев", "нин", "пов", "син", "тов", "хин"),
    ),
}
#: First and last letters of other scripts from which names are drawn letter by letter.
LETTERS = (
    ("Α", "Ρ"), ("Σ", "Ω"), ("α", "ρ"), ("σ", "ω"), ("א", "ת"), ("ا", "غ"), ("ف", "ي"), ("अ", "ह"), ("ぁ", "ん"), ("ァ", "ン"), ("一", "龥"), ("가", "힣"), ("Ա", "Ֆ"), ("ա", "ֆ"), ("ა", "ჰ"),
)

_TITLE = {t: g for g, titles in TITLES.items() for t in titles}
_GENDER = {name: g for (_, g), names in GIVEN.items() for name in names}
_NAME = r"[^\W\d_a-zа-яß-öø-ÿ][^\W\d_]+(?:-[^\W\d_]+)?"
_LED = re.compile(rf"\b({'|'.join(sorted(_TITLE, key=len, reverse=True))})\.? ({_NAME}(?: {_NAME}){{0,2}})")
_KNOWN = re.compile(rf"\b((?:{'|'.join(_GENDER)}) {_NAME})\b")


def _resolved(names: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """Gender and name as written, with the value of the person in this document: the fullest name, the most specific gender."""
    told = {(g, n): g if g != "x" or " " not in n else _GENDER.get(n.split()[0], "x") for g, n in names}
    people = {(g, n) for (_, n), g in told.items()}
    short = lambda n: {n.split()[-1], f"{n.split()[0]} {n.split()[-1]}"}

    def one(found: list) -> tuple[str, str] | None:
        return found[0] if len(found) == 1 else None

    into: dict[tuple[str, str], tuple[str, str]] = {}
    for g, n in sorted(people, key=lambda x: (-len(x[1].split()), x[0] == "x", x)):
        same = one([p for p in people if p[1] == n and p[0] != "x"]) if g == "x" else None
        fuller = one([p for p in {into.get(p, p) for p in people} if len(p[1].split()) > len(n.split()) and n in short(p[1]) and (g == "x" or p[0] in (g, "x"))])
        into[g, n] = into.get(fuller, fuller) or same or (g, n)
    gender: dict[tuple[str, str], set[str]] = {}
    for (g, _), person in into.items():
        gender.setdefault(person, set()).add(g)
    value = {p: f"{one(sorted(gs - {'x'})) or p[0]}:{p[1]}" for p, gs in gender.items()}
    return {name: value[into[g, name[1]]] for name, g in told.items()}


def _people(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """start, end, value of the persons found, one value for all names of a person, and of their bare names elsewhere in text.

    A bare name that several persons have is the one's who was named last.
    """
    values = _resolved([tuple(v.split(":", 1)) for _, _, v in found])
    named = [(s, e, values[tuple(v.split(":", 1))]) for s, e, v in found]
    owners: dict[str, list[tuple[int, str]]] = {}
    for s, _, value in sorted(named):
        words = value.split(":", 1)[1].split()
        for name in {" ".join(words), f"{words[0]} {words[-1]}" if len(words) > 1 else words[0], words[0], words[-1]}:
            for form in {name, name.upper()}:
                owners.setdefault(form, []).append((s, value))
    bare = re.compile(rf"(?<![\w-])(?:{'|'.join(map(re.escape, sorted(owners, key=len, reverse=True)))})(?![\w-])")
    places = sorted((s, e) for s, e, _ in named)
    for m in bare.finditer(text):
        at = bisect.bisect_left(places, m.span())
        if (at == 0 or places[at - 1][1] <= m.start()) and (at == len(places) or places[at][0] >= m.end()):
            own = owners[m[0]]
            named.append((*m.span(), own[max(bisect.bisect_left(own, (m.start(),)) - 1, 0)][1]))
    return named


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    """start, end, type of ip, card, ssn, phone and loosely grouped card matches, looked for only where a long number stands."""
    for m in _NUMERIC.finditer(text):
        low, high = m.start(), min(m.end() + 2, len(text))  # what is ahead counts, at most two characters of it
        for kind in ("ip", "card", "ssn", "phone"):
            for found in PATTERNS[kind].finditer(text, low, high):
                yield *found.span(), kind
        for found in _LOOSE_CARD.finditer(text, low, high):
            yield *found.span(), "loose"


def _iban_rest(value: str) -> int:
    """1 for valid account numbers."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, type, value of all mentions in order; where some overlap, the first of the earlier type.

    The value of a person is the fullest name in the text behind its gender (f, m, or x:
    untold) and a colon; a mention may hold a part of that name.
    """
    found = []
    rank = {kind: i for i, kind in enumerate(TYPES)}
    if "@" in text:
        found += [(m.start(), rank["email"], m.end(), "email", m[0].lower()) for m in PATTERNS["email"].finditer(text)]
    if text.count(":") > 1:
        for m in _IPV6.finditer(text):
            try:
                found.append((m.start(), rank["ip"], m.end(), "ip", ipaddress.IPv6Address(m[0]).exploded))
            except ValueError:
                pass
    for m in PATTERNS["iban"].finditer(text):
        value = m[0].replace(" ", "")
        if 15 <= len(value) <= 34 and _iban_rest(value) == 1:
            found.append((m.start(), rank["iban"], m.end(), "iban", value))
    for start, end, kind in _numbers(text):
        written = text[start:end]
        value = written if kind == "ip" else re.sub(r"\D", "", written)
        if kind == "loose":
            found.append((start, rank["card"] + 0.5, end, "card", value))
        elif kind != "phone" or 7 <= len(value) <= 15:
            found.append((start, rank[kind], end, kind, value))
    if any(t in text for t in _TITLE):
        found += [(m.start(2), rank["person"], m.end(2), "person", f"{_TITLE[m[1]]}:{m[2]}") for m in _LED.finditer(text)]
    if any(n in text for n in _GENDER):
        found += [(m.start(1), rank["person"] + 1, m.end(1), "person", f"{_GENDER[m[1].split()[0]]}:{m[1]}") for m in _KNOWN.finditer(text)]
    taken, out = [], []
    for start, _, end, kind, value in sorted(found, key=lambda x: (x[1], x[0])):
        at = bisect.bisect_left(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
            taken.insert(at, (start, end))
            out.append((start, end, kind, value))
    people = [(s, e, v) for s, e, kind, v in out if kind == "person"]
    if people:
        out = [x for x in out if x[2] != "person"]
        others = sorted((s, e) for s, e, *_ in out)
        for s, e, v in _people(text, people):
            at = bisect.bisect_left(others, (s, e))
            if (at == 0 or others[at - 1][1] <= s) and (at == len(others) or others[at][0] >= e):
                out.append((s, e, "person", v))
    return sorted(out)


class _Draws:
    """Keyed random numbers for one entity and attempt."""

    def __init__(self, key: bytes, *of: str):
        self.state = hashlib.blake2b("\0".join(of).encode(), key=key, digest_size=32).digest()
        self.pool = int.from_bytes(self.state, "big")

    def below(self, n: int) -> int:
        if self.pool < n << 64:
            self.state = hashlib.blake2b(self.state, digest_size=32).digest()
            self.pool = self.pool << 256 | int.from_bytes(self.state, "big")
        self.pool, found = divmod(self.pool, n)
        return found


def _redrawn(text: str, draws: _Draws) -> str:
    """Each letter and digit replaced by one of its class."""
    classes = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
    return "".join(next((c[draws.below(len(c))] for c in classes if x in c), x) for x in text)


def _luhn(digits: str) -> int:
    """Sum that is 0 for valid card numbers."""
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def _script(name: str) -> str:
    """latin, cyrillic or other, by the first letter."""
    first = unicodedata.name(next((c for c in name if c.isalpha()), "a"), "")
    return "latin" if first.startswith("LATIN") else "cyrillic" if first.startswith("CYRILLIC") else "other"


def _family(script: str, sex: str, parts: int, draws: _Draws) -> str:
    made = ["".join(s[draws.below(len(s))] for s in SYLLABLES[script]) for _ in range(parts)]
    return "-".join(f"{x}а" if (script, sex) == ("cyrillic", "f") else x for x in made)


def name_parts(entities: int) -> int:
    """Parts that family names need so that there are ``ROOM`` for each entity."""
    least = min(math.prod(map(len, s)) for s in SYLLABLES.values())
    parts = 1
    while least**parts < ROOM * entities:
        parts += 1
    return parts


def _letters(word: str, draws: _Draws) -> str:
    """Each letter replaced by one of its script."""
    out = []
    for c in word:
        low, high = next(((a, b) for a, b in LETTERS if a <= c <= b), (c, c))
        out.append(chr(ord(low) + draws.below(ord(high) - ord(low) + 1)))
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0, parts: int = 1) -> str:
    """The replacement of a value, free of format; parts: of a family name."""
    draws = _Draws(key, kind, value, str(attempt))
    if kind == "email":
        local, _, domain = value.partition("@")
        *labels, top = domain.split(".")
        home = _Draws(key, "domain", domain)
        return f"{_redrawn(local, draws)}@{'.'.join(_redrawn(x, home) for x in labels)}.{top}"
    if kind == "ip" and ":" in value:
        return value[:4] + "".join("0123456789abcdef"[draws.below(16)] if c != ":" else c for c in value[4:])
    if kind == "ip":
        first = int(value.split(".")[0])
        return ".".join([str(first if first in (10, 127) else 1 + draws.below(223))] + [str(draws.below(256)) for _ in range(2)] + [str(1 + draws.below(254))])
    if kind == "card":
        body = value[0] + _redrawn(value[1:-1], draws)
        last = draws.below(10) if _luhn(value) else next(d for d in range(10) if not _luhn(body + str(d)))
        return body + str(last)
    if kind == "phone":
        kept = len(value) - 10 if len(value) > 10 else 0
        return value[:kept] + str(2 + draws.below(8)) + _redrawn(value[kept + 1 :], draws)
    if kind == "person":
        gender, name = value.split(":", 1)
        script, words = _script(name), name.split()
        if script == "other":
            return " ".join(_letters(w, draws) for w in words) + "".join(_letters(words[-1][-1], draws) for _ in range(attempt))
        sex = gender if gender != "x" else _GENDER.get(words[0]) or "fm"[_Draws(key, "gender", value).below(2)]
        made = [_family(script, sex, parts, draws)]
        if len(words) > 1:
            given = [x for x in GIVEN[(script, sex)] if x not in words]
            made.insert(0, given[draws.below(len(given))])
        for _ in words[2:]:
            made.insert(1, _family(script, sex, 1, draws))
        return " ".join(made)
    if kind == "iban":
        body = _redrawn(value[4:], draws)
        return f"{value[:2]}{98 - _iban_rest(f'{value[:2]}00{body}'):02d}{body}"
    return _redrawn(value, draws)


def _formatted(kind: str, mention: str, value: str, of: str) -> str:
    """The surrogate of the value of in the mention's format; of a person, the part that the mention names."""
    if kind == "email":
        return "".join(v.upper() if m.isupper() else v for m, v in zip(mention, value, strict=False)) + value[len(mention) :]
    if kind == "iban":
        signs = iter(value)
        return "".join(c if c == " " else next(signs) for c in mention)
    if kind in ("card", "ssn", "phone"):
        digits = iter(value)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "person" and len(part := mention.split()) < len(whole := of.split(":", 1)[1].split()):
        made = value.split()
        value = f"{made[0]} {made[-1]}" if len(part) > 1 else made[-1] if part[0].lower() == whole[-1].lower() else made[0]
    if kind == "person" and mention.isupper():
        return value.upper()
    return value


def entities(docs: DataFrame) -> DataFrame:
    """type, value: the different entities of docs."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = {(kind, value) for t in b["text"] for _, _, kind, value in mentions(t)}
            yield pd.DataFrame(sorted(seen), columns=["type", "value"])

    return docs.select(whole_text().alias("text")).mapInPandas(found, "type string, value string").distinct()


def attempts(found: DataFrame, key: bytes) -> DataFrame:
    """type, value, attempt, surrogate such that surrogates are distinct and none is a value of found."""

    parts = name_parts(found.filter("type = 'person'").count())

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, *x, parts) for x in zip(kind, value, attempt, strict=True)], dtype=object)

    surrogates = lambda df: stored(df.withColumn("surrogate", drawn("type", "value", "attempt")), "surrogates")
    current = surrogates(found.withColumn("attempt", F.lit(0)))
    while True:
        order = F.struct("attempt", "value")
        first = current.groupBy("type", "surrogate").agg(F.min(order).alias("first"))
        taken = current.select("type", F.when(F.col("type") == "person", F.substring_index("value", ":", -1)).otherwise(F.col("value")).alias("surrogate"), F.lit(True).alias("taken")).distinct()
        judged = current.join(first.hint("shuffle_hash"), ["type", "surrogate"]).join(taken.hint("shuffle_hash"), ["type", "surrogate"], "left")
        judged = stored(judged.select("type", "value", "attempt", "surrogate", (F.coalesce("taken", F.lit(False)) | (order != F.col("first"))).alias("again")), "judged")
        if judged.filter("again").isEmpty():
            return current
        moved = judged.filter("again").select("type", "value", (F.col("attempt") + 1).alias("attempt"))
        current = stored(judged.filter("not again").drop("again").unionByName(surrogates(moved)), "surrogates")


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with personal data replaced in text; adds entities (array of type, start, end, surrogate; places in the input).

    key: 1 to 64 secret bytes.  Null texts become empty; they and empty texts have no
    entities.  Very long texts are scanned whole.  Of matches that overlap the earlier type
    wins, then the earlier place.  Rows that repeat are rewritten alike; a null doc_id stays
    null; an empty table gives no rows.  A column named entities is replaced, others stay.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() != "entities"]
    moved_name, made_name, key_name = (free_name(docs.columns, c) for c in ("_moved", "_made", "_key"))
    found = stored(entities(docs), "entities")
    parts = name_parts(found.filter("type = 'person'").count())
    moved = attempts(found, key).filter("attempt > 0")
    n_moved = moved.count()
    if n_moved <= BROADCAST_VALUES:
        known = spark.sparkContext.broadcast({(r["type"], r["value"]): r["surrogate"] for r in moved.select("type", "value", "surrogate").collect()})
        rows = docs.withColumn(moved_name, F.lit(None).cast("map<string,string>"))
    else:
        known = None

        def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                seen = {(k, kind, value) for k, t in zip(b["_key"].tolist(), b["text"], strict=True) for _, _, kind, value in mentions(t)}
                yield pd.DataFrame(sorted(seen), columns=["_key", "type", "value"])

        there = docs.select(doc_key().alias("_key"), whole_text().alias("text")).mapInPandas(places, "_key long, type string, value string")
        name = F.concat_ws("\0", "type", "value")
        by_doc = there.join(moved.hint("shuffle_hash"), ["type", "value"]).groupBy(F.col("_key").alias(key_name)).agg(F.map_from_entries(F.collect_set(F.struct(name, "surrogate"))).alias(moved_name))
        rows = docs.select(*[f"`{c}`" for c in own], doc_key().alias(key_name)).join(stored(by_doc, "moved").hint("shuffle_hash"), key_name, "left")

    @F.pandas_udf("text string, entities array<struct<type: string, start: int, `end`: int, surrogate: string>>")
    def rewritten(text: pd.Series, moved_: pd.Series) -> pd.DataFrame:
        out = []
        for t, own_moved in zip(text, moved_, strict=True):
            parts_, found_, at = [], [], 0
            other = {tuple(k.split("\0", 1)): v for k, v in own_moved.items()} if own_moved else known.value if known else {}
            for start, end, kind, value in mentions(t):
                made = _formatted(kind, t[start:end], other.get((kind, value)) or surrogate(key, kind, value, 0, parts), value)
                parts_ += [t[at:start], made]
                found_.append({"type": kind, "start": start, "end": end, "surrogate": made})
                at = end
            out.append(("".join([*parts_, t[at:]]), found_))
        return pd.DataFrame(out, columns=["text", "entities"])

    made = rows.withColumn(made_name, rewritten(whole_text(), F.col(f"`{moved_name}`")))
    return made.select(*[F.col(f"`{made_name}`.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in own], F.col(f"`{made_name}`.entities").alias("entities"))
