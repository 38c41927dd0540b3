"""Operator 10: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features count words of two lexicons: INSULTS, common insults of four languages, which need no labels, and a learned one
(words and word beginnings that stand out in toxic texts). The labelled rows in use are dealt into two halves by a
hash: for the trees, each half is measured by the lexicon that the other half taught, so that a word that is only toxic
by chance is not believed. Calibration is by margins that each row gets from trees fitted without it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, cut, map_rows

#: Learning takes at most this many labelled rows, those with the smallest hash of their id.
FIT_ROWS = 24_000
LEXICON_SIZE = 2_000
#: Log-likelihood ratio from which a word's share of toxic texts is no chance, though thousands of words are tried.
CERTAIN = 18.0
#: Log odds from which a word counts as strong.
STRONG = 4.0
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.2
#: A lexicon to begin with: fixed values, common insults in English, French, German and Spanish that are no ordinary word
#: in another of them.
INSULTS = frozenset("""
    idiot idiots idiotic stupid moron morons moronic imbecile dumb dumbass dimwit loser losers pathetic worthless scum trash garbage filth filthy vermin
    pig pigs bastard bastards bitch bitches asshole assholes jerk jerks cretin freak freaks retard retarded disgusting despicable coward cowards
    shit shitty crap fuck fucking fucker ugly useless creep creeps parasite parasites subhuman
    imbécile crétin crétins débile débiles connard connards connasse salaud salope ordure ordures pourriture abruti abrutis minable minables merde putain
    idiote idiotes stupide stupides bouffon lâche parasites racaille
    idioten dummkopf dumme trottel depp deppen vollidiot abschaum versager arschloch schwein schweine dreck dreckig scheiße scheisse wichser hure
    schwachkopf widerlich ekelhaft wertlos nutzlos ungeziefer feigling mistkerl hass
    idiota idiotas estúpido estúpida estúpidos imbécil imbéciles tonto perdedor perdedora basura escoria asqueroso asquerosa inútil mierda puta puto
    cabrón gilipollas cerdo cobarde patético patética despreciable maldito maldita
    """.split())
#: Words that address the reader.
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer ti tú usted ustedes vosotros vuestro".split())
#: Signs that stand for letters.
LEET = str.maketrans("0134578@$!€", "oieastba" + "si" + "e")
PUNCTUATION = "!?.,;:"
FEATURES = ("insults", "insult_density", "strongest", "total", "strong", "hits", "density", "distinct", "obfuscated", "address", "capitals", "shouts", "marks", "symbols", "length")
#: Folds in which margins for the calibration are made.
FOLDS = 5
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INSIDE = re.compile(r"[\W_]+")


def terms_of(word: str) -> tuple[str, ...]:
    """What the lexicon may hold of a word: itself and its beginnings of four to seven letters."""
    return (word, *(word[:k] + "~" for k in range(4, min(8, len(word)))))


def plain(token: str) -> str:
    return _EDGE.sub("", token)


class Words(dict):
    """Token -> (lexicon weight, whether only its plain spelling is in a lexicon, whether it is one of INSULTS)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def weigh(self, word: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)

    def __missing__(self, token: str) -> tuple[float, bool, bool]:
        word = plain(token)
        found = (self.weigh(word), False, word in INSULTS)
        if not found[0] and not found[2] and word and not word.isalpha():
            spelt = _INSIDE.sub("", word.translate(LEET))
            found = (self.weigh(spelt), True, spelt in INSULTS)
        if len(self) > 300_000:
            self.clear()
        self[token] = found
        return found


def measure(text: str | None, words: Words) -> tuple[float, ...]:
    """FEATURES of a whole text; zeros for an empty one."""
    if not text:
        return (0.0,) * len(FEATURES)
    tokens = text.lower().split()
    n = max(1, len(tokens))
    found = [words[t] for t in tokens]
    weights = [w for w, _, _ in found]
    insults = sum(x for _, _, x in found)
    at = [i for i, (w, _, insult) in enumerate(found) if w or insult]
    hidden = sum(words[tokens[i]][1] for i in at)
    address = 0
    for i in at:
        address += any(plain(t) in SECOND_PERSON for t in tokens[max(0, i - 5) : i + 6])
    size = len(text)
    return (
        float(insults),
        100.0 * insults / n,
        max(weights, default=0.0),
        sum(weights) / n,
        float(sum(w >= STRONG for w in weights)),
        float(len(at)),
        100.0 * len(at) / n,
        float(len({plain(tokens[i])[:4] for i in at})),
        100.0 * hidden / n,
        100.0 * address / n,
        sum(map(str.isupper, text)) / size if not text.islower() else 0.0,
        100.0 * text.count("!") / n,
        100.0 * sum(map(text.count, PUNCTUATION)) / n,
        100.0 * sum(map(text.count, "*#$%&@")) / n,
        math.log1p(len(tokens)),
    )


def learn_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """(text, toxic) -> term: weight, the terms that occur in toxic texts far more than chance; counted on the executors."""

    def count(b):
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            words = {plain(t) for t in text.lower().split()}
            found[toxic].update({x for w in words if w.isalpha() for x in terms_of(w)})
        every = found[0] + found[1]
        return {"term": list(every), "bad": [found[1][t] for t in every], "all": list(every.values())}

    n_all, n_bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n_good = n_all - n_bad
    if not n_bad or not n_good:
        return {}
    counted = map_rows(sample, count, "term string, bad long, all long", 1024).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
    good = F.col("all") - F.col("bad")
    p_bad, p_good = (F.col("bad") + 0.5) / (n_bad + 1), (good + 0.5) / (n_good + 1)
    weight = F.log(p_bad) - F.log(p_good)
    far = lambda n, p: F.when(n > 0, n * F.log(n / (F.col("all") * p))).otherwise(0.0)
    ratio = 2 * (far(F.col("bad"), n_bad / n_all) + far(good, n_good / n_all))
    least = max(3, math.ceil(0.01 * n_bad))
    best = counted.where((F.col("bad") >= least) & (weight > 1.5) & (ratio >= CERTAIN)).select("term", weight.alias("weight"))
    rows = best.orderBy(F.desc("weight"), "term").limit(size).collect()
    return {r["term"]: min(6.0, round(r["weight"], 6)) for r in rows}


class Trees:
    """Gradient-boosted trees of fixed depth for 0/1 targets: histograms of feature bins, second-order gains."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE):
        self.trees, self.depth, self.bins, self.rate = trees, depth, bins, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rows, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base = math.log(mean / (1 - mean))
        margin = np.full(rows, self.base)
        self.feature, self.edge, self.value = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(rows, np.int64)
            features, cuts = [], []
            for level in range(self.depth):
                count = 1 << level
                best = np.full(count, 1e-9)
                feature, cut_at, edge = np.zeros(count, np.int64), np.full(count, self.bins), np.full(count, np.inf)
                for f in range(width):
                    slot = node * self.bins + binned[:, f]
                    g = np.bincount(slot, grad, count * self.bins).reshape(count, self.bins)
                    h = np.bincount(slot, hess, count * self.bins).reshape(count, self.bins)
                    gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                    gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < 0.1) | (ht - hl < 0.1)] = 0
                    gain[:, len(edges[f]) :] = 0
                    at = gain.argmax(1)
                    better = gain[np.arange(count), at] > best
                    best[better], feature[better], cut_at[better] = gain[np.arange(count), at][better], f, at[better]
                    edge[better] = edges[f][at[better]] if len(edges[f]) else np.inf
                features.append(feature)
                cuts.append(edge)
                node = node * 2 + (binned[np.arange(rows), feature[node]] > cut_at[node])
            leaves = 1 << self.depth
            g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
            value = -self.rate * g / (h + 1)
            margin += value[node]
            self.feature.append(features)
            self.edge.append(cuts)
            self.value.append(value)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        row = np.arange(len(x))
        for features, edges, value in zip(self.feature, self.edge, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for feature, edge in zip(features, edges, strict=True):
                node = node * 2 + (x[row, feature[node]] > edge[node])
            margin += value[node]
        return margin


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: margins and the non-decreasing probabilities there; between them they are interpolated."""
    points, at = np.unique(margin, return_inverse=True)
    total, ones = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []  # mean, weight, first point, last point
    for p, w, s in zip(points, total, ones, strict=True):
        blocks.append([s / w, w, p, p])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, weight, _, end = blocks.pop()
            top = blocks[-1]
            blocks[-1] = [(top[0] * top[1] + mean * weight) / (top[1] + weight), top[1] + weight, top[2], end]
    x = [v for b in blocks for v in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    p = [b[0] for b in blocks for _ in range(2 if b[3] > b[2] else 1)]
    return np.array(x), np.array(p)


class Model:
    """Lexicon, trees and calibration; picklable, a few hundred kB."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, curve: tuple[np.ndarray, np.ndarray] | None, prior: float):
        self.lexicon, self.trees, self.curve, self.prior = lexicon, trees, curve, prior

    def score(self, texts: list[str | None], words: Words | None = None) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        words = words if words is not None else Words(self.lexicon)
        margin = self.trees.predict(np.array([measure(t, words) for t in texts]).reshape(-1, len(FEATURES)))
        return np.clip(np.interp(margin, *self.curve), 0.0, 1.0)


def held_out(fold: int = 1, folds: int = 3) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on rows of docs that are not held out and have a label (0 or 1).

    Equal texts count once, so that copies do not make a word common; a text with both labels is left out. Without rows of
    both labels, every score is the share of toxic rows (0 without any). At most fit_rows labels and at most fit_rows different
    texts are used, whatever number of texts a repeated doc_id has: those of the smallest hashes.
    """
    marks = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    known = docs.where(~held_out() & F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    known = known.withColumn("key", F.xxhash64("text"))
    one = known.groupBy("key").agg(F.first("text").alias("text"), F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    sample = cut(one.select("key", "text", "toxic", F.pmod(F.xxhash64("key"), F.lit(2 * FOLDS)).alias("part")), "toxicity-fit")
    if sample.count() > fit_rows:
        sample = sample.join(F.broadcast(sample.select("key").orderBy("key").limit(fit_rows)), "key")
    prior = float(sample.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0])
    halves = [F.col("part") < FOLDS, F.col("part") >= FOLDS]
    # what a half's texts are measured by, the other half has taught
    taught = [learn_lexicon(sample.where(half).select("text", "toxic")) for half in reversed(halves)]

    def features(lexicon):
        def measured(b):
            words = Words(lexicon)
            return {"toxic": b["toxic"], "part": b["part"], "x": [list(measure(t, words)) for t in b["text"]]}

        return measured

    measured = [map_rows(sample.where(half), features(lexicon), "toxic int, part int, x array<double>", 2048) for half, lexicon in zip(halves, taught, strict=True)]
    rows = measured[0].union(measured[1]).collect()  # at most fit_rows
    lexicon = learn_lexicon(sample.select("text", "toxic"))
    rows.sort(key=lambda r: (r["part"], r["x"], r["toxic"]))
    x, y, part = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["toxic"] for r in rows], float), np.array([r["part"] for r in rows])
    if len(set(y)) < 2:
        return Model(lexicon, None, None, prior)
    margins = np.empty(len(y))
    for fold in range(FOLDS):
        mine = part % FOLDS == fold
        others = y[~mine]
        # a fold whose rest has one label says nothing of its own rows but the share
        margins[mine] = Trees().fit(x[~mine], others).predict(x[mine]) if len(set(others)) == 2 else 0.0
    return Model(lexicon, Trees().fit(x, y), isotonic(margins, y), prior)


@lru_cache(maxsize=2)
def _words(key: int, items: tuple) -> Words:
    return Words(dict(items))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """All columns of docs (doc_id, text, ...) and score (0 to 1), predicted (1 if score >= threshold), held_out.

    Null and empty texts are scored as texts without words. Each row of docs gives one row, whatever its doc_id;
    columns of docs that are named like results are replaced. A doc_id with several labels counts as toxic if one is.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, fit_rows))

    def score(b):
        found = model.value.score(b["text"], _words(len(model.value.lexicon), tuple(model.value.lexicon.items())))
        return {"score": found.tolist(), "predicted": (found >= threshold).astype(int).tolist()}

    return add_columns(docs.withColumn("held_out", held_out()), ["text"], score, "score double, predicted int")
