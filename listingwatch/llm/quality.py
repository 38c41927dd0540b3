"""Operator 8: quality rules as weak supervision.

Each rule votes good (1), bad (0) or abstains. Votes of all documents are counted by vote pattern (at most 3 to the
number of rules rows, whatever the corpus holds); expectation-maximisation over these counts estimates what
each rule says of good and of bad documents, and each pattern gets the posterior probability of being good.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

#: Rule -> (column or expression, good if at most, bad if above); between the two it abstains.
RULES = {
    "repeats": ("100.0 * n_repeat_words / greatest(n_words, 1)", 20.0, 35.0),
    "symbols": ("100.0 * n_symbols / greatest(n_words, 1)", 5.0, 10.0),
    "dup_lines": ("100.0 * n_dup_lines / greatest(n_lines, 1)", 20.0, 30.0),
    "letters": ("100.0 - 100.0 * n_lettered / greatest(n_words, 1)", 10.0, 20.0),
    "word_length": ("abs(word_chars / greatest(n_words, 1) - 6.5)", 3.0, 5.0),
    "capitals": ("100.0 * n_capitals / greatest(word_chars, 1)", 15.0, 40.0),
    "stops": ("100.0 * n_stops / greatest(n_words, 1)", 20.0, 40.0),
}
_LETTER = re.compile(rb"[A-Za-z]")
SYMBOLS = "#*$%&|<>"
STOPS = "!?"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ROUNDS = 50
ABSTAIN = 2
#: What a rule is believed to say before any document is seen, (bad, good, nothing): of bad and of good documents. A bad
#: document is blamed by some rules only; a good one hardly by any, as the bounds in RULES are set for that.
BELIEF = ((0.15, 0.82, 0.03), (0.001, 0.979, 0.02))
#: Share of good documents before any is seen, and how many documents that is worth; how many bad and good ones BELIEF is worth.
#: They don't grow with the table, so they decide a small one and fade from a large one.
PRIOR_GOOD, PRIOR_SHARE, PRIOR_WEIGHT = 0.9, 20.0, (5.0, 120.0)


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_stops, n_lettered (words with a
    letter) of a whole text."""
    if not text:
        return (0,) * 9
    words = text.encode().split()  # bytes.split() parts at the six ASCII spaces and nothing else
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
        m = np.uint64(len(number))
        if len(number) < 2_000_000:  # three numbers fit into 64 bits
            windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
        else:
            windows = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    # a word without an ASCII letter is looked at again for other letters
    bare = sum(not any(map(str.isalpha, w.decode())) for w in words if not w.isalpha() and not _LETTER.search(w))
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), capitals, sum(map(text.count, STOPS)), n - bare


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_stops", "n_lettered"]


def vote(rule: str):
    value, good, bad = RULES[rule]
    return F.when(F.expr(value) <= good, 1).when(F.expr(value) > bad, 0).otherwise(ABSTAIN)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior probability of `good` for each vote pattern (rows of 0, 1, ABSTAIN), by EM over pattern counts.

    What a rule says (bad, good or nothing) has a distribution for good and one for bad documents: its accuracies. EM
    starts from BELIEF, which says which class is the good one, and estimates them from how the rules agree over all documents;
    BELIEF stays in as PRIOR_WEIGHT documents of either kind.
    """
    said = np.stack([patterns == v for v in (0, 1, ABSTAIN)]).astype(float)  # vote, pattern, rule
    belief = np.repeat(np.array(BELIEF)[:, :, None], patterns.shape[1], 2)  # class, vote, rule
    chance, share = belief, PRIOR_GOOD
    weight = np.array(PRIOR_WEIGHT)[:, None, None]
    for _ in range(rounds):
        bad_log, good_log = (np.einsum("vpr,vr->p", said, np.log(c)) for c in chance)
        good = 1 / (1 + np.exp(np.clip(np.log(1 - share) + bad_log - np.log(share) - good_log, -500, 500)))
        votes = np.stack([np.einsum("p,vpr->vr", counts * w, said) for w in (1 - good, good)]) + weight * belief
        chance = votes / votes.sum(1, keepdims=True)
        share = (counts @ good + PRIOR_SHARE * PRIOR_GOOD) / (counts.sum() + PRIOR_SHARE)
    return good


def judge(docs: DataFrame, min_words: int = 50, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good for each row of docs.

    A null or empty text has no words and fails the base rule. One row for each row of docs, whatever its doc_id;
    other columns are not read.
    """

    def features(b):
        found = zip(*map(measure, b["text"]), strict=True)
        return {"doc_id": b["doc_id"]} | dict(zip(COLUMNS, map(list, found), strict=True))

    measured = map_rows(docs.select("doc_id", "text"), features, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS))
    measured = cut(measured.withColumn("votes", F.array(*[vote(r) for r in RULES])), "quality")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # what fails the base rule is decided and would only blur what the rules say of the rest
    tally = measured.groupBy("votes").agg(F.count(F.when(~failed, 1)).alias("count")).collect()  # at most 3 ** len(RULES) rows
    p_good = F.lit(None).cast("double")
    if tally:
        good = fit(np.array([r["votes"] for r in tally]), np.array([r["count"] for r in tally], float))
        table = docs.sparkSession.createDataFrame([(r["votes"], float(p)) for r, p in zip(tally, good, strict=True)], "votes array<int>, p_good double")
        measured, p_good = measured.join(F.broadcast(table), "votes"), F.col("p_good")
    return measured.select("doc_id", *COLUMNS[:5], failed.alias("base_failed"), (~failed & (p_good >= threshold)).alias("kept"), p_good.alias("p_good"))
