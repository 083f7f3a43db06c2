"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, all but letters become single spaces, and the n-grams of 1 to 3 characters are counted by hash
over the whole text. Log counts times inverse document frequency, at unit length, are the features. Training follows
the regularised leader (FTRL-proximal) with an elastic-net penalty, so that most weights are exactly zero; a part of
the training rows is set aside to choose the temperature that calibrates the probabilities.

Cases: a null text or one without a letter is `und` with score 0. Without training rows every text is `und`.
Repeated rows are scored alike; languages that score alike are tied by name; an empty table gives no rows. Only text is
read for a prediction; extra columns of any name aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphreel.llm.common import held_out, map_text, table

BITS = 15
DIM = 1 << BITS
#: Training documents read for each language at most, chosen by a hash of the id.
FIT_PER_LANG = 700
#: Languages that are learned at most, those with most training rows; bounds what is broadcast and sent to the driver.
FIT_LANGS = 1000
UND = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams and their counts; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    total = np.zeros(DIM, np.int64)
    carry = np.zeros(0, np.uint32)
    # long texts go through in blocks that overlap by two characters
    for at in range(0, len(codes), 1 << 20):
        block, ok = codes[at : at + (1 << 20)], is_letter[at : at + (1 << 20)]
        c = np.where(ok, block, 32)
        c = c[ok | np.concatenate(([True] if at == 0 else is_letter[at - 1 : at], ok[:-1]))]
        edge = [32] if not len(carry) else []
        end = [32] if at + (1 << 20) >= len(codes) else []
        new = len(carry)
        c = np.concatenate((carry, edge, c, end)).astype(np.uint64)
        one = c * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:]
        three = two[:-1] * np.uint64(0x165667B19E3779F9) + one[2:]
        for x, fresh in ((one, new), (two, max(0, new - 1)), (three, max(0, new - 2))):
            x = x[fresh:]
            mixed = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            total += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=DIM)
        carry = c[-2:].astype(np.uint32)
    ids = np.flatnonzero(total)
    return ids, total[ids]


@dataclass
class LangModel:
    langs: list[str]
    idf: np.ndarray
    rows: np.ndarray  # feature -> row of weights, or -1
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, g: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = g
        x = (1 + np.log(n)) * self.idf[ids]
        norm = np.sqrt((x * x).sum())
        return ids, x / norm if norm else x

    def logits(self, g: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        ids, x = self.vector(g)
        rows = self.rows[ids]
        used = rows >= 0
        return x[used] @ self.weights[rows[used]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text)
        if g is None or not self.langs:
            return UND, 0.0
        z = self.logits(g) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, p[k]))


def fit(rows: list[tuple[str, str]], epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> LangModel:
    """rows: (text, language). Every fifth row only calibrates."""
    langs = sorted({y for _, y in rows})
    at = {y: i for i, y in enumerate(langs)}
    data = [(g, at[y]) for t, y in rows if (g := grams(t)) is not None]
    df = np.zeros(DIM)
    for (ids, _), _ in data:
        df[ids] += 1
    idf = np.log((1 + len(data)) / (1 + df)) + 1
    k = max(1, len(langs))
    model = LangModel(langs, idf, np.arange(DIM), np.zeros((DIM, k)), np.zeros(k))
    order = np.random.default_rng(7).permutation(len(data))
    train = [data[i] for j, i in enumerate(order) if j % 5]
    rest = [data[i] for j, i in enumerate(order) if j % 5 == 0]
    xs = [(*model.vector(g), y) for g, y in train]
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weight(i: np.ndarray) -> np.ndarray:
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for ids, x, y in xs:
            i, v = np.append(ids, DIM), np.append(x, 1.0)
            w = weight(i)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(DIM + 1))
    used = np.flatnonzero(np.abs(w[:DIM]).sum(1))
    model.rows = np.full(DIM, -1)
    model.rows[used] = np.arange(len(used))
    model.weights, model.bias = w[used], w[DIM]
    if rest:
        scores, ys = np.array([model.logits(g) for g, _ in rest]), np.array([y for _, y in rest])

        def loss(t: float) -> float:
            s = scores / t
            m = s.max(1)
            return float(np.mean(np.log(np.exp(s - m[:, None]).sum(1)) + m - s[np.arange(len(s)), ys]))

        model.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
    return model


def train(spark: SparkSession, docs: DataFrame, per_lang: int = FIT_PER_LANG) -> LangModel:
    """From rows with a language that aren't held out, per_lang of each language at most."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    # one plan for any number of languages: a language's least hashes, about twice as many as wanted, are ranked
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows")).orderBy(F.desc("_rows"), "lang").limit(FIT_LANGS)
    hashed = known.withColumn("_hash", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).join(F.broadcast(sizes), "lang")
    few = hashed.where(F.col("_hash").cast("double") * F.col("_rows") < F.lit(float((2 * per_lang + 100) << 40)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id"))
    chosen = few.withColumn("_place", place).where(F.col("_place") <= per_lang).select("doc_id")
    picked = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull()).join(F.broadcast(chosen.distinct()), "doc_id", "left_semi")
    return fit(sorted((r["text"], r["lang"]) for r in picked.select("text", "lang").toLocalIterator()))


def predict_documents(docs: DataFrame, model: LangModel, keys: list[str]) -> DataFrame:
    def make() -> Callable:
        letters()
        return model.predict

    return map_text(docs, keys, "text", make, "lang_pred string, score double")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_documents(docs, train(spark, docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
