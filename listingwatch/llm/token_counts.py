"""Operator 4: token counts by a deterministic transducer that is compiled from a BPE vocabulary.

A tokenizer that always merges the best pair first has a left-to-right form: the tokens of a prefix are those of a shorter
prefix and one more token, and which one that is depends on the last tokens of the prefixes before it only, for a
sequence of tokens is what the tokenizer gives exactly if each two neighbours are. So the transducer's state is, for
each of the last places where a piece that is still open could start, the last token there and the difference in tokens to
here; a transition reads a character and is annotated with the tokens it emits (less than zero where it joins earlier ones). States and transitions are
compiled when they are first met and equal states are one, so that a long run of one letter goes round in a circle.

The vocabulary also fixes where no token can cross: no piece holds a word mark (U+2581, which a space becomes)
after another character, and some characters occur in no longer piece at all. Between such places lie units; behind each
the transducer is back in its first state. A chunk of a text maps the state it is entered in to the state it is left in and
a count. From its first certain boundary on, the entry no longer matters, so the map is held exactly as (head before the
first boundary, tokens of whole units, tail after the last boundary). Maps compose to maps of that form and composing is
associative: long texts are dealt out by chunks, and their maps are composed in a scan of two levels over tasks.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

CHUNK = 65_536
#: Neighbouring chunk maps that a task of the scan's first level composes; with a second level that is enough for
#: 2 ** 32 characters, more than a text can have.
FAN = 256
#: States, and counts of short units, that each Python worker keeps.
REMEMBERED, UNITS = 250_000, 500_000
SHORT = 40
MARK = "▁"


class StateMap(NamedTuple):
    """What a chunk does to the state: if `whole` is None it has no boundary and only lengthens the open unit."""

    head: str
    whole: int | None
    tail: str


class Transducer:
    """Characters -> number of tokens that sentencepiece's BPE gives for a marked text."""

    def __init__(self, model: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(lib.vocab_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.pieces = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("this vocabulary has pieces that hold a word mark inside")
        if not lib.encode("a", out_type=str)[0].startswith(MARK):
            raise ValueError("this model adds no word mark before a text")
        if len(lib.encode("\U0010fffe")) < 4:
            raise ValueError("this model does not spell unknown characters as bytes")
        #: What a piece can begin with: characters that the state has to keep, as a piece over them could still come.
        self.begun = {p[:i] for p in self.pieces for i in range(1, len(p))}
        inside = {c for p in self.pieces if len(p) > 1 for c in p}
        #: Line ends and other ASCII that no longer piece holds stand alone.
        self.alone = "".join(c for c in map(chr, range(128)) if c not in inside and c != " ")
        alone = re.escape(self.alone)
        #: A unit: one character that stands alone, or marks and then what follows up to the next boundary.
        self.unit = re.compile((f"[{alone}]|" if alone else "") + f"{MARK}*[^{MARK}{alone}]+|{MARK}+")
        self.neighbours: dict[tuple[str, str], bool] = {}
        self.units: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the first state alone."""
        self.known = {("", ("",), (0,)): 0}
        #: Of each state: what has been read of open pieces, at which places before here they start, with the last token
        #: and the difference in tokens there; and its transitions.
        self.states: list[tuple] = [("", (0,), ("",), (0,))]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def follows(self, before: str, token: str) -> bool:
        """Whether the tokenizer leaves two neighbouring tokens as they are: it always merges the best pair, the leftmost
        of equals, and no merge crosses from one into the other."""
        key = (before, token)
        found = self.neighbours.get(key)
        if found is None:
            if len(self.neighbours) > 4 * REMEMBERED:
                self.neighbours.clear()
            found = self.neighbours[key] = self.apart(before, token)
        return found

    def apart(self, before: str, token: str) -> bool:
        parts, left, score = [*before, *token], len(before), self.pieces.get
        pairs = [score(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, x in enumerate(pairs):
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                return len(parts) == (left > 0) + 1 and left <= 1
            if at == left - 1:
                return False
            left -= at < left
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at])

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition of a state over a character: next state and emitted tokens."""
        tail, places, lasts, ahead = self.states[state]
        size, pieces = len(tail), self.pieces
        for place, last, before in zip(places, lasts, ahead, strict=True):  # the longest token first
            token = tail[size - place :] + char
            if (not place or token in pieces) and self.follows(last, token):
                break
        emitted = before + (1 if token in pieces else len(token.encode()))
        tail += char
        after_places, after_lasts, after_ahead = [], [], []
        for place, last, before in zip(places, lasts, ahead, strict=True):
            if tail[size - place :] in self.begun:
                after_places.append(place + 1)
                after_lasts.append(last)
                after_ahead.append(before - emitted)
        tail = tail[size + 1 - after_places[0] :] if after_places else ""
        new = (tail, (*after_places, 0), (*after_lasts, token), (*after_ahead, 0))
        key = (tail, new[2], new[3])  # the places follow from what is read
        after = self.known.setdefault(key, len(self.states))
        if after == len(self.states):
            self.states.append(new)
            self.moves.append({})
        self.moves[state][char] = (after, emitted)
        return after, emitted

    def run(self, unit: str) -> int:
        """Tokens of a whole unit, from the first state."""
        state = n = 0
        for char in unit:
            state, emitted = self.moves[state].get(char) or self.compile(state, char)
            n += emitted
        return n

    def tokens(self, units: list[str]) -> int:
        known, n = self.units, 0
        for unit in units:
            found = known.get(unit)
            if found is None:
                if len(self.states) > REMEMBERED:
                    self.forget()
                if len(known) > UNITS:
                    known.clear()
                found = self.run(unit)
                if len(unit) <= SHORT:
                    known[unit] = found
            n += found
        return n

    def state_map(self, chunk: str) -> StateMap:
        """chunk: marks in place of spaces."""
        units = self.unit.findall(chunk)
        if len(units) < 3:
            return StateMap(chunk, None, "")
        return StateMap(units[0], self.tokens(units[1:-1]), units[-1])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First a, then b."""
        if a.whole is None and b.whole is None:
            return self.state_map(a.head + b.head)
        joined = self.unit.findall((a.head if a.whole is None else a.tail) + b.head)
        if a.whole is None:
            return StateMap(joined[0], b.whole + self.tokens(joined[1:]), b.tail)
        if b.whole is None:
            return StateMap(a.head, a.whole + self.tokens(joined[:-1]), joined[-1])
        return StateMap(a.head, a.whole + b.whole + self.tokens(joined), b.tail)

    def total(self, whole: StateMap) -> int:
        """Tokens of a text from its map, entered in the first state."""
        return self.tokens(self.unit.findall(whole.head)) + ((whole.whole + self.tokens([whole.tail])) if whole.whole is not None else 0)

    def count(self, text: str) -> int:
        return self.tokens(self.unit.findall(marked(text))) if text else 0


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK)


@cache
def transducer(model: str) -> Transducer:
    return Transducer(model)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no tokens. One row for each row of docs, whatever its doc_id (null or repeated);
    other columns are not read. Texts of more than `chunk` characters are written out with a row number, cut into
    chunks and counted by any number of tasks.
    """
    schema = "doc_id long, n_bytes long, n_tokens long"
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))

    def count(b):
        machine = transducer(model)
        return {"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": [machine.count(t) for t in b["text"]]}

    short = map_rows(rows.where(F.length("text") <= chunk), count, schema)
    long = cut(rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "token-texts")

    def chunks(b):
        found = [(row, no, t[at : at + chunk]) for row, t in zip(b["row"], map(marked, b["text"]), strict=True) for no, at in enumerate(range(0, len(t), chunk))]
        return dict(zip(("row", "no", "text"), map(list, zip(*found, strict=True)), strict=True))

    def maps(b):
        machine = transducer(model)
        found = map(machine.state_map, b["text"])
        return {"row": b["row"], "no": b["no"]} | dict(zip(StateMap._fields, map(list, zip(*found, strict=True)), strict=True))

    def compose(table: pa.Table) -> StateMap:
        parts = sorted(table.to_pylist(), key=lambda r: r["no"])
        return reduce(transducer(model).compose, (StateMap(r["head"], r["whole"], r["tail"]) for r in parts))

    def first_level(key, table):
        found = compose(table)
        return pa.table({"row": key[0:1], "no": key[1:2], "head": [found.head], "whole": pa.array([found.whole], pa.int64()), "tail": [found.tail]})

    def second_level(key, table):
        return pa.table({"row": key[0:1], "n_tokens": pa.array([transducer(model).total(compose(table))], pa.int64())})

    state_map = "row long, no long, head string, whole long, tail string"
    dealt = map_rows(long.select("row", "text"), chunks, "row long, no long, text string", 16).repartition("row", "no")
    found = map_rows(dealt, maps, state_map, 32)
    found = found.groupBy("row", F.floor(F.col("no") / fan).alias("part")).applyInArrow(first_level, state_map)
    found = found.groupBy("row").applyInArrow(second_level, "row long, n_tokens long")
    counted = long.select("row", "doc_id", "n_bytes").join(found, "row").select("doc_id", "n_bytes", "n_tokens")
    return short.union(counted).withColumn("over_limit", F.col("n_tokens") > limit)
