"""Operator 7: language identification with string kernels.

The kernel of two texts is the cosine of their blended-spectrum presence vectors: which letter n-grams of 1 to ORDER
characters occur at all, hashed to GRAMS places. Kernel ridge regression, one language against the rest, is fitted in
the Nyström space of LANDMARKS training texts. As the kernel is a product of presence vectors, landmarks, Nyström
map and ridge weights multiply out to one matrix (gram, language; 128 kB a language), and texts are scored by batched
products with it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

ORDER = 4
GRAMS = 1 << 15
#: Landmark texts; one of each language at least.
LANDMARKS = 160
RIDGE = 1e-2
#: The fit takes about this many different texts of each language, chosen by a hash of the text, and MOST_ROWS in all
#: (4 kB each on the driver); where languages are so many that their share is less than one, one of each.
FIT_ROWS, MOST_ROWS = 400, 20_000
#: Languages whose weights a worker can hold (128 kB each).
MOST_LANGUAGES = 2_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


@cache
def letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else a space."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)


def presence(text: str | None) -> np.ndarray | None:
    """Places of the n-grams that a whole text holds, sorted; None if it has no letter."""
    if not text:
        return None
    points = letters()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
    if not (points != 32).any():
        return None
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    seen = np.zeros(GRAMS, bool)
    h = np.zeros(len(points), np.uint64)
    for n in range(ORDER):
        h = (h[:-1] if n else h) * _STEP + points[n:] + np.uint64(n + 1)
        seen[((h ^ (h >> np.uint64(31))) * _STEP) >> np.uint64(64 - GRAMS.bit_length() + 1)] = True
    return np.flatnonzero(seen)


def fit(samples: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """(language, packed presence bits) -> languages and the matrix (GRAMS, languages)."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return [], np.zeros((GRAMS, 0))
    dense = lambda rows: np.unpackbits(np.array([np.frombuffer(b, np.uint8) for _, b in rows]), axis=1, count=GRAMS).astype(np.float32)
    unit = lambda x: x / np.sqrt(x.sum(1, keepdims=True))
    by_lang: list[list[tuple[str, bytes]]] = [[] for _ in languages]
    place = {lang: i for i, lang in enumerate(languages)}
    for s in samples:
        by_lang[place[s[0]]].append(s)
    landmarks = max(landmarks, len(languages))
    chosen = [s for i in range(max(map(len, by_lang))) for rows in by_lang for s in rows[i : i + 1]][:landmarks]
    marks = unit(dense(chosen))
    kernel = np.concatenate([unit(dense(samples[i : i + 128])) @ marks.T for i in range(0, len(samples), 128)]).astype(float)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    strong = values > 1e-6 * values[-1]
    root = vectors[:, strong] / np.sqrt(values[strong])  # Nyström map
    z = np.hstack([kernel @ root, np.ones((len(samples), 1))])
    of = np.array([place[s[0]] for s in samples])
    weighed = z / np.array([len(rows) for rows in by_lang])[of][:, None]  # languages weigh the same
    # targets are 1 for a row's own language and -1 for the others
    own = np.zeros((len(languages), z.shape[1]))
    np.add.at(own, of, weighed)
    weights = np.linalg.solve(z.T @ weighed + ridge * np.eye(z.shape[1]) / len(languages), (2 * own - weighed.sum(0)).T)
    matrix = marks.T.astype(float) @ (root @ weights[:-1])
    return languages, np.vstack([matrix, weights[-1:]]).astype(np.float32)


def predict(texts: list[str | None], languages: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """Best language and its score (0 to 1: ridge output -1 to 1 moved and clipped); `und` and 0 without a letter."""
    found = [presence(t) for t in texts]
    have = [i for i, x in enumerate(found) if x is not None]
    best, score = ["und"] * len(texts), [0.0] * len(texts)
    if have and languages:
        places = [found[i] for i in have]
        starts = np.cumsum([0, *map(len, places[:-1])])
        product = np.add.reduceat(matrix[np.concatenate(places)], starts, dtype=float) / np.sqrt([len(x) for x in places])[:, None] + matrix[-1]
        for i, row in zip(have, product, strict=True):
            k = int(row.argmax())
            best[i], score[i] = languages[k], float(np.clip((row[k] + 1) / 2, 0, 1))
    return best, score


def held_out(fold: int = 2, folds: int = 4):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS, most_rows: int = MOST_ROWS, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang).

    Learns from rows that are not held out and have a text with a letter and a language: all languages, and of each about
    fit_rows different texts (less if they would be more than most_rows in all, but one at least). A null or empty text, or one
    without a letter, is `und` with score 0; so is every text if there is nothing to learn from. A null doc_id counts
    as an empty one. Repeated rows are rows like any other and are learnt once; other columns are not read. The model has a
    column of weights a language and is broadcast; more than most_languages different values of lang, which no column of
    languages has, are refused with a ValueError.
    """
    lettered = F.col("text").rlike(r"\p{L}")
    known = docs.where(~held_out() & F.col("lang").isNotNull() & lettered).select("text", "lang", F.xxhash64("text").alias("draw"))
    # a language's texts with the smallest hash: one is kept of each language, so none is lost
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("count"), F.min("draw").alias("least")), "languages")
    n_languages = counts.count()
    if n_languages > most_languages:
        raise ValueError(f"{n_languages} values of lang; more than {most_languages} are no languages")
    each = max(1, min(fit_rows, most_rows // max(1, n_languages)))
    reach = F.least(F.lit(1.0), F.lit(float(each)) / F.col("count")) * float(2**64) - float(2**63)
    drawn = known.join(counts, "lang").where((F.col("draw") == F.col("least")) | (F.col("draw") < reach))
    drawn = drawn.select("lang", "draw", "text").dropDuplicates(["lang", "draw"])

    def bits(b):
        found = [(lang, presence(t)) for lang, t in zip(b["lang"], b["text"], strict=True)]
        found = [(lang, x) for lang, x in found if x is not None]
        packed = [np.packbits(np.bincount(x, minlength=GRAMS) > 0).tobytes() for _, x in found]
        return {"lang": [lang for lang, _ in found], "bits": packed}

    samples = sorted((r["lang"], bytes(r["bits"])) for r in map_rows(drawn, bits, "lang string, bits binary").collect())
    languages, matrix = fit(samples)
    model = docs.sparkSession.sparkContext.broadcast((languages, matrix))

    def score(b):
        best, value = predict(b["text"], *model.value)
        return {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": best, "score": value}

    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return map_rows(rows, score, "doc_id long, held_out boolean, lang_pred string, score double", 64)
