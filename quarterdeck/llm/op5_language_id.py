"""Language identification in two steps: first the family, then one-versus-one linear support vector machines inside it.

Features are counts of byte n-grams (two and three bytes, ASCII in lower case, everything that is no letter as one blank) hashed into a
vector of unit length. Training takes at most `sample` whole texts per language, a documented bound, and the averaged Pegasos method on the
driver; prediction reads every whole text in Arrow batches with weights of fixed size.

Defined results: a null text, or one without a letter, is `und` with score 0. Without labelled rows everything is `und`. With one language
only, that is predicted with score 1. Languages outside the family table are families of their own. Ties go to the first in alphabetical order. Repeated rows
are predicted alike, an empty table gives no rows, and a column with a result's name is replaced.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import appended

SIZE = 1 << 14
# Families of common languages.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
}
FAMILY = {language: family for family, languages in FAMILIES.items() for language in languages.split()}
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def vector(text: bytes | None) -> np.ndarray:
    """Hashed n-gram counts of a whole text, of unit length; zeros for a text without letters."""
    data = _FOLD[np.frombuffer(text or b"", np.uint8)]
    data = data[np.flatnonzero((data[1:] != 32) | (data[:-1] != 32)) + 1] if len(data) > 1 else data
    wide = np.concatenate([[32], data, [32]]).astype(np.uint32)
    two = wide[:-1] << 8 | wide[1:]
    three = two[:-1] << 8 | wide[2:]
    at = np.concatenate([two * np.uint32(2654435761), (three + np.uint32(77)) * np.uint32(2246822519)]) >> np.uint32(32 - 14)
    counts = np.sqrt(np.bincount(at, minlength=SIZE).astype(np.float32))
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def separator(x: np.ndarray, y: np.ndarray, rounds: int = 12, penalty: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Weights of a linear support vector machine for y in {-1, 1}: averaged Pegasos; both classes count alike."""
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1], np.float64)
    mean, step = np.zeros_like(w), 0
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    for r in range(rounds):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            step += 1
            wrong = y[batch] * (x[batch] @ w) < 1
            rate = 1 / (penalty * (step + 200))
            w *= 1 - rate * penalty
            w += rate / len(batch) * ((weight * y)[batch][wrong] @ x[batch][wrong])
            w *= min(1.0, 1 / (np.sqrt(penalty) * max(1e-12, np.linalg.norm(w))))
        if r >= rounds // 2:
            mean += w
    return (mean / (rounds - rounds // 2)).astype(np.float32)


@dataclass
class Model:
    """families: names with their languages. first and inside: separators of pairs of families, and of pairs of languages in each family."""

    families: dict[str, list[str]]
    first: dict[tuple[str, str], np.ndarray]
    inside: dict[tuple[str, str], np.ndarray]

    def choose(self, names: list[str], pairs: dict[tuple[str, str], np.ndarray], x: np.ndarray) -> tuple[str, float]:
        """The name with most votes (then the largest sum of margins) and the mean chance against its rivals."""
        if len(names) == 1:
            return names[0], 1.0
        votes, sums, chance = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            margin = float(x @ pairs[a, b])
            sure = 1 / (1 + np.exp(-4 * margin))
            votes[a if margin >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + margin, sums[b] - margin
            chance[a], chance[b] = chance[a] + sure, chance[b] + 1 - sure
        best = max(names, key=lambda n: (votes[n], sums[n]))
        return best, chance[best] / (len(names) - 1)

    def predict(self, text: bytes) -> tuple[str, float]:
        x = vector(text)
        family, sure = self.choose(sorted(self.families), self.first, x)
        language, inner = self.choose(self.families[family], self.inside, x)
        return language, min(1.0, max(0.0, sure * inner))


def sampled(labelled: DataFrame, text: str, lang: str, order: str, sample: int) -> DataFrame:
    """About `sample` rows of each language, picked by a hash against the language's share; the driver sees one count per language."""
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(order).alias("key"), F.col(text).alias("text"))
    share = F.lit(0)
    for r in usable.groupBy("lang").count().collect():
        share = F.when(F.col("lang") == r["lang"], F.lit(-(-(sample << 20) // r["count"]))).otherwise(share)
    return usable.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", sample: int = 400) -> Model:
    """Fits on at most `sample` texts of each language, picked by a hash of `order`. Their vectors are made by the executors from whole texts;
    the driver holds sample x languages vectors of at most SIZE numbers."""

    def start() -> Callable[[list], list[list]]:
        def work(texts: list) -> list[list]:
            made = [vector(t) for t in texts]
            at = [np.flatnonzero(v) for v in made]
            return [[a.astype("<u2").tobytes() for a in at], [v[a].astype("<f4").tobytes() for v, a in zip(made, at, strict=True)]]

        return work

    fields = [T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType())]
    taken: dict[str, int] = {}
    rows = []
    for r in sorted(appended(sampled(labelled, text, lang, order, sample), "text", fields, start).drop("text").collect(), key=lambda r: (str(r["key"]), r["at"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= sample:
            rows.append(r)
    names = sorted({r["lang"] for r in rows})
    families: dict[str, list[str]] = {}
    for name in names:
        families.setdefault(FAMILY.get(name, f"only {name}"), []).append(name)
    x = np.zeros((len(rows), SIZE), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f4")
    language = np.array([r["lang"] for r in rows])
    family = np.array([FAMILY.get(r["lang"], f"only {r['lang']}") for r in rows])

    def pairs(of: np.ndarray, among: list[str]) -> dict[tuple[str, str], np.ndarray]:
        out = {}
        for a, b in combinations(among, 2):
            here = (of == a) | (of == b)
            out[a, b] = separator(x[here], np.where(of[here] == a, 1.0, -1.0))
        return out

    inside = {}
    for members in families.values():
        inside |= pairs(language, members)
    return Model(families, pairs(family, sorted(families)), inside)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def start() -> Callable[[list], list[list]]:
        held = shared.value

        def work(texts: list) -> list[list]:
            made = [held.predict(t) if t and held.families else ("und", 0.0) for t in texts]
            return [[m[0] for m in made], [m[1] for m in made]]

        return work

    lettered = docs.withColumn("__lettered", F.when(F.col(text).rlike(r"\p{L}"), F.col(text)))
    return appended(lettered, "__lettered", fields, start).drop("__lettered")
