"""Operator 13: fill-in-the-middle transformation over an indexable skip list.

A text's units (lines or characters) are the nodes of a skip list. Every link of every lane carries how many units and how
many code points it spans; going down the lanes by accumulated units reaches the rank of a cut in a logarithmic number of steps,
and the code points summed up on the way say where to cut the text. Cuts, form and order come from a hash of the doc_id, so
runs agree and no row needs another.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Prefix, suffix and middle marks.
MARKS = ("<P>", "<S>", "<M>")
#: One node in FAN goes up to the next lane.
FAN = 4


def line_widths(text: str) -> np.ndarray:
    """Code points of each line with its line feed; the last one may lack it."""
    widths = np.fromiter(map(len, text.split("\n")), np.int64) + 1
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


def char_widths(text: str) -> np.ndarray:
    return np.ones(len(text), np.int64)


UNITS = {"line": line_widths, "char": char_widths}


class SkipList:
    """Lanes of links; lane 0 has a link for each unit. A link starts at a node and carries (units, code points)."""

    def __init__(self, widths: np.ndarray):
        self.size = len(widths)
        at = np.concatenate([[0], np.cumsum(widths)])  # code points before each node; the last node is the end
        nodes = np.arange(self.size + 1)
        # a node's height comes from a hash of its number: lanes are the same whenever they are built
        mixed = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed >>= np.uint64(32)
        self.lanes, share = [], 1
        while True:
            tall = nodes if share == 1 else nodes[(mixed % np.uint64(share) == 0) | (nodes == 0) | (nodes == self.size)]
            down = np.searchsorted(self.lanes[-1][2], tall) if self.lanes else tall  # the same node in the lane below
            self.lanes.append((np.diff(tall), np.diff(at[tall]), tall, down))
            if len(tall) <= 2 or share > self.size:
                break
            share *= FAN

    def offset(self, rank: int) -> int:
        """Code points before the unit of this rank (0 to size)."""
        place = units = points = 0
        for lane in range(len(self.lanes) - 1, -1, -1):
            unit_widths, point_widths, _, down = self.lanes[lane]
            while place < len(unit_widths) and units + unit_widths[place] <= rank:
                units += int(unit_widths[place])
                points += int(point_widths[place])
                place += 1
            if lane:
                place = int(down[place])
        return points


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    name = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transform(text: str, doc_id: int | None, units: str, rate: int, spm_rate: int, seed: int, marks: tuple[str, str, str]):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    widths = UNITS[units](text)
    n = len(widths)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate or any(x in text for x in marks):
        return n, "plain", None, None, text
    lanes = SkipList(widths)
    a, b = sorted((lanes.offset(h1 % (n + 1)), lanes.offset(h2 % (n + 1))))
    p, s, m = marks
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def fill_in_middle(docs: DataFrame, units: str = "line", rate: int = 100, spm_rate: int = 50, seed: int = 7, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row of docs.

    rate: of 100 documents, how many are cut; spm_rate: of 100 of those, how many have their suffix first. A null text is an
    empty one; empty texts and texts that hold a mark stay plain. Rows with one doc_id are cut at the same ranks; a null
    doc_id counts as an id without digits. Other columns are not read. marks must not start or end alike.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(b):
        made = [transform(t or "", i, units, rate, spm_rate, seed, marks) for i, t in zip(b["doc_id"], b["text"], strict=True)]
        return {"doc_id": b["doc_id"]} | {k: [x[j] for x in made] for j, k in enumerate(names)}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", 64)


def restore(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """made (form, output) with column `restored`: the text that it was made of, found by the marks alone."""
    p, s, m = marks

    def parted(column, mark):
        both = F.split(column, re.escape(mark), 2)
        return both[0], both[1]

    def body(first):
        return F.substring("output", len(first) + 1, 2**31 - 1)

    prefix, rest = parted(body(p), s)
    suffix, middle = parted(rest, m)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = parted(body(s), p)
    prefix, middle = parted(rest, m)
    spm = F.concat(prefix, middle, suffix)
    return made.withColumn("restored", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output")))
