"""Exact token counts by a finite-state transducer compiled from a sentencepiece BPE model.

**Transducer.**  Byte-pair merging is local: a sequence of pieces is the encoding of
its text exactly if each adjacent pair is the encoding of its own text.  The encoding
of a prefix therefore follows from the encodings of the shorter prefixes at which a
piece may still be open.  A state keeps just these: for every suffix of the text read
so far that begins some piece, the last piece before it and how many pieces fewer had
been emitted there.  Reading one character leads to one next state and changes the
count by a fixed number, with which the transition is annotated (it may be negative:
``th`` + ``e`` can turn two pieces into one).  States and transitions are compiled on
demand and kept per Python worker, as are the counts of whole words.

**Chunks.**  A text is cut into chunks of ``chunk_chars``.  A chunk stands for a map
from the state before it to the state after it and a count.  After the first barrier
(a space after a non-space, or a line break, over which no piece reaches) every state
leads to the same one, so the map is written as: the characters before the barrier, the
count behind it, the state at the end.  Such maps compose associatively; the chunks of
a document are computed wherever Spark puts them and composed by a prefix scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.stage import whole_text

CHUNK_CHARS = 32_768
SPACE = "▁"
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
_BARRIER = re.compile(f"(?<=[^{SPACE}]){SPACE}|(?<=\n)")
#: What a worker keeps at most of words, of pairs and of states; beyond, it starts anew.
_MEMO_LIMIT = 250_000
_STATE_LIMIT = 350_000
_MACHINES: dict[str, Transducer] = {}


class Transducer:
    """States, transitions and counts of one model; built as texts need them."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not any(f(i) for f in special)}
        self.begins = {piece[:n] for piece in self.scores for n in range(1, len(piece) + 1)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, int] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.places: dict[tuple, tuple] = {}
        self.start = self.state(("", ((0, "", 0),)))

    def state(self, key: tuple) -> dict:
        """The transitions of a state by character: (next state, change of the count)."""
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = {None: key}
        return found

    def merged(self, text: str) -> list[str]:
        """The model's merges on a short text: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.scores.get(parts[i] + parts[i + 1], float("-inf")), -i))
            if parts[best] + parts[best + 1] not in self.scores:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def adjacent(self, left: str, right: str) -> bool:
        """May right follow left in an encoding?  left is empty after a barrier."""
        pair = (left, right)
        if (found := self.fits.get(pair)) is None:
            if len(self.fits) > _MEMO_LIMIT:
                self.fits.clear()
            found = self.fits[pair] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def compile(self, state: dict, char: str) -> tuple[dict, int]:
        """The transition from state by char."""
        suffix, places = state[None]
        if char == SPACE and suffix[-1:] != SPACE:  # a barrier: nothing before it matters
            suffix, places = "", ((0, "", 0),)
        opened, kept = [], self.places.setdefault
        last, count = None, 0
        for length, before, fewer in places:
            piece = (suffix[-length:] if length else "") + char
            if last is None and piece in self.scores and self.adjacent(before, piece):
                last, count = piece, fewer + 1
            if piece in self.begins:
                opened.append((length + 1, before, fewer))
        if last is None:  # not in the vocabulary: one piece a byte, and a barrier
            last, count, opened = "", len(char.encode()), []
        key = ((suffix + char)[-opened[0][0] :] if opened else char, tuple([kept(p, p) for p in [(n, b, c - count) for n, b, c in opened] + [(0, last, 0)]]))
        step = state[char] = (self.state(key), count)
        return step

    def run(self, state: dict, text: str) -> tuple[dict, int]:
        """State and count after text."""
        total = 0
        for char in text:
            step = state.get(char) or self.compile(state, char)
            state = step[0]
            total += step[1]
        return state, total

    def words(self, units: list[str]) -> int:
        """Pieces of units that begin and end at barriers."""
        if len(self.states) > _STATE_LIMIT:
            self._restart()
        memo, total = self.memo, 0
        for unit in units:
            if (n := memo.get(unit)) is None:
                n = self.run(self.start, unit)[1]
                if len(unit) <= 32:
                    if len(memo) >= _MEMO_LIMIT:
                        memo.clear()
                    memo[unit] = n
            total += n
        return total

    # -- chunk maps ---------------------------------------------------------------

    def chunk_map(self, text: str, first: bool, last: bool) -> tuple[str, int, str | None]:
        """(characters before the first barrier, count behind it, state at the end or None without barrier)."""
        text = text.replace(" ", SPACE)
        if first:
            head, rest = "", SPACE + text if text else ""
        elif cut := _BARRIER.search(text, 1):
            head, rest = text[: cut.start()], text[cut.start() :]
        else:
            return text, 0, None
        lead = re.match(f"[^{SPACE}]*", rest)[0]
        total = self.run(self.start, lead)[1] if lead else 0
        units = _UNIT.findall(rest, len(lead))
        if last:
            return head, total + self.words(units), ""
        total += self.words(units[:-1])
        state, more = self.run(self.start, units[-1] if units else lead)
        return head, total + (more if units else 0), json.dumps(state[None])

    def compose(self, left: tuple, right: tuple) -> tuple:
        """left, then right, as one map; associative."""
        if left[2] is None:
            return (left[0] + right[0], right[1], right[2])
        suffix, places = json.loads(left[2])
        state, more = self.run(self.state((suffix, tuple(map(tuple, places)))), right[0])
        total = left[1] + more + right[1]
        return (left[0], total, json.dumps(state[None]) if right[2] is None else right[2])

    def scan(self, maps: list[tuple]) -> int:
        """Pieces of a document: its chunk maps composed pairwise, level by level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0][1]


def machine(model_file: str) -> Transducer:
    """This Python worker's transducer."""
    if model_file not in _MACHINES:
        _MACHINES[model_file] = Transducer(model_file)
    return _MACHINES[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_chunks, over_limit for every row of docs.

    Equal to ``len(SentencePieceProcessor.encode(text))``.  A null or empty text has 0
    bytes and 0 tokens; a null doc_id stays null; rows that repeat a doc_id give one row
    each; columns other than doc_id and text are ignored.
    """

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer = machine(model_file)
        for b in batches:
            made = [transducer.chunk_map(t, i == 0, i == n - 1) for t, i, n in zip(b["chunk"], b["at"], b["n"], strict=True)]
            out = b[["row", "doc_id", "n_bytes", "n", "at"]].copy()
            out["head"], out["body"], out["tail"] = [list(x) for x in zip(*made, strict=True)] if made else ([], [], [])
            yield out

    @F.pandas_udf("long")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        transducer = machine(model_file)
        for b in batches:
            yield pd.Series([transducer.scan([(m["head"], m["body"], m["tail"]) for m in sorted(ms, key=lambda m: m["at"])]) for ms in b], dtype="int64")

    text = whole_text()
    chunks = F.when(F.length(text) <= chunk_chars, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), chunks.alias("chunks"))
    parts = rows.select("row", "doc_id", "n_bytes", F.size("chunks").alias("n"), F.posexplode("chunks").alias("at", "chunk"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = parts.mapInPandas(maps, f"row long, doc_id {id_type}, n_bytes long, n int, at int, head string, body long, tail string")
    whole = made.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_bytes").alias("n_bytes"),
        F.max("n").cast("long").alias("n_chunks"),
        F.collect_list(F.struct("at", "head", "body", "tail")).alias("maps"),
    )
    counted = whole.select("doc_id", "n_bytes", scanned("maps").alias("n_tokens"), "n_chunks")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
