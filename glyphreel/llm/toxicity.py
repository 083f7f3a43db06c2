"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes disguises: compatibility forms, case, look-alike letters of other scripts, stray combining and
zero-width marks, and digits or signs that stand for letters inside a word. One automaton holds the lexicon
(stems match at the start of a word) and the exception phrases; a hit inside an exception phrase is void. The sum
of the weights is divided by the number of words and a logistic curve turns the rate into a score.

Cases: a null or empty text has no hits and gets the score of a clean text. Repeated rows are scored alike, each with a
row of its own. Without labels of both classes the base lexicon and the default curve are used. A document labelled
twice counts by its largest label; stems that gain alike are tied by length, then by name; a score of exactly 0.5 is
predicted 1. An empty table gives no rows. Extra columns of any name aren't read. The walk over a text is linear in its
length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphreel.llm.common import held_out, keep_rows, labelled_sample, map_text, table

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    {"а": "a", "в": "b", "е": "e", "з": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j"}
    | {"ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ɡ": "g", "ɑ": "a", "ı": "i", "ł": "l", "ø": "o", "đ": "d"}
    | {"α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w"}
)
#: Digits and signs that stand for letters; l, i, 1 and the like fall together.
DIGITS = str.maketrans("01345789@$!", "oieastbgasi")
SAME = str.maketrans("l", "i")
#: Base lexicon and exception phrases; the fit adds stems and weights from labels.
BASE = {"idiot": 4.0, "moron": 4.0, "scum": 4.0, "stupid": 3.0, "pathetic": 3.0, "worthless": 3.0, "loser": 3.0, "disgusting": 3.0, "clown": 2.5, "trash": 2.5}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "sore loser award", "idiot proof", "idiot light")
#: Labelled documents that the fit reads at most, by label.
FIT_TOXIC, FIT_CLEAN = 3000, 4000

_HIDDEN = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff\\u0300-\\u036f]+")
#: Anything but ASCII and the common accented letters takes the long way.
_ODD = re.compile("[\\u0080-\\u00bf×÷øđıłØĐŁĲĳĿŀŉſ]|[^\\x00-\\u024f]")
_SIGN = re.compile(r"[01345789@$]+|!+(?=[^\W\d_])")
_BREAK = re.compile(r"[\W_]+")
#: On UTF-8 bytes: everything in ASCII but letters and digits is a space, l is i.
_BYTES = bytes(c if c > 127 else ord(chr(c).translate(SAME)) if chr(c).isalnum() else 32 for c in range(256))


def fold(text: str) -> str:
    """Words of plain lower-case letters between single spaces, a space at both ends, as UTF-8 bytes read as Latin-1."""
    if _ODD.search(text):
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower().translate(LOOK_ALIKES)
    else:
        text = text.lower()

    def sign(m: re.Match) -> str:
        a, b = m.span()
        return m[0].translate(DIGITS) if (a and text[a - 1].isalpha()) or (b < len(text) and text[b].isalpha()) else m[0]

    text = _SIGN.sub(sign, text)
    if not text.isascii() and _ODD.search(text):
        text = _BREAK.sub(" ", text)
    return " " + b" ".join(text.encode("utf-8", "replace").translate(_BYTES).split()).decode("latin-1") + " "


def outside(found: dict[int, float], shelter: list[tuple[int, int]]) -> dict[int, float]:
    """The hits that no shelter holds, in one walk over both by place."""
    out, far, rest = {}, -1, iter(sorted(shelter))
    a, b = next(rest)
    for at in sorted(found):
        while a is not None and a <= at:
            far = max(far, b)
            a, b = next(rest, (None, None))
        if at >= far:
            out[at] = found[at]
    return out


@dataclass
class Toxicity:
    """stems: weight by folded stem; whole: weight by folded whole word; rate curve: sigmoid(slope*log1p(rate)+bias)."""

    stems: dict[str, float] = field(default_factory=lambda: {fold(k).strip(): v for k, v in BASE.items()})
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.5
    bias: float = -3.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for stem, w in self.stems.items():
            a.add_word(" " + stem, (len(stem) + 1, w))
        for phrase in self.exceptions:
            p = " " + fold(phrase).strip()
            a.add_word(p + " ", (len(p) + 1, None))
        a.make_automaton()
        return a

    def rater(self) -> Callable[[str | None], tuple[float, int, int]]:
        """text -> (weight for a thousand words, hits, words)."""
        auto = self.automaton()

        def rate(text: str | None) -> tuple[float, int, int]:
            if not text:
                return 0.0, 0, 0
            t = fold(text)
            words = t.count(" ") - 1
            found, shelter = {}, []
            for end, (n, w) in auto.iter(t):
                if w is None:
                    shelter.append((end - n + 1, end))
                else:  # of stems that begin at the same word the heaviest counts
                    at = end - n + 1
                    found[at] = max(found.get(at, w), w)
            if shelter:
                found = outside(found, shelter)
            return 1000.0 * sum(found.values()) / max(words, 1), len(found), words

        return rate

    def score(self, rate: float) -> float:
        z = self.slope * math.log1p(rate) + self.bias
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def fit(self, rows: list[tuple[str, int]], least: int = 3, precision: float = 0.9) -> Toxicity:
        """Chooses stems that cover the toxic texts with few clean ones, greedily, weighs them by log odds, fits the curve."""
        toxic, clean = [fold(t).split() for t, y in rows if y == 1], [fold(t).split() for t, y in rows if y == 0]
        if not toxic or not clean:
            return self

        def features(words: list[str]) -> set[str]:
            return {w[:n] for w in set(words) for n in range(3, min(len(w), 9) + 1)}

        seen = Counter()
        holds: dict[str, list[int]] = defaultdict(list)
        for w in toxic:
            seen.update(features(w))
        wanted = {f for f, n in seen.items() if n >= least}
        bad = Counter()
        for w in clean:
            bad.update(features(w) & (wanted | self.stems.keys()))
        wanted = {f for f in wanted if seen[f] / len(toxic) * precision >= (1 - precision) * 10 * bad[f] / len(clean) and seen[f] >= precision * (seen[f] + bad[f])}
        for i, w in enumerate(toxic):
            for f in features(w) & wanted:
                holds[f].append(i)
        # every toxic text shall hold two chosen stems if it can, for texts to come that hold one of them only
        stems, want = dict(self.stems), {}
        known = self.automaton()
        for i, w in enumerate(toxic):
            want[i] = 2 - len({end - v[0] for end, v in known.iter(" " + " ".join(w) + " ") if v[1] is not None})
        open_ = {i for i, n in want.items() if n > 0}
        enough = max(least + 1, len(toxic) // 40)
        for s in stems:
            n, b = seen.get(s, 0), bad[s]
            stems[s] = max(0.5, math.log((n + 0.5) / (len(toxic) + 1) / ((b + 0.5) / (len(clean) + 1)))) if n else stems[s]
        gain = {f: len(x) for f, x in holds.items()}
        while open_ and gain:
            # most newly covered toxic texts; of equals the longer stem, which is the more specific one
            best = max(gain, key=lambda f: (gain[f] - 3 * bad[f], len(f), f))
            fresh = len(open_.intersection(holds[best]))
            if fresh == gain[best]:
                if fresh - 3 * bad[best] < enough:
                    break
                stems[best] = max(0.5, math.log((seen[best] + 0.5) / (len(toxic) + 1) / ((bad[best] + 0.5) / (len(clean) + 1))))
                del gain[best]
                # forms of the same stem hold no further evidence
                gain = {f: n for f, n in gain.items() if not f.startswith(best) and not best.startswith(f)}
                for i in open_.intersection(holds[best]):
                    want[i] -= 1
                    if want[i] <= 0:
                        open_.discard(i)
                continue
            if fresh and fresh != gain[best]:
                gain[best] = fresh
            else:
                del gain[best]
        fitted = Toxicity(stems, self.exceptions)
        rate = fitted.rater()
        x = np.log1p([rate(t)[0] for t, _ in rows])
        y = np.array([t for _, t in rows], float)
        each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        beta = np.array([0.0, 0.0])
        a = np.stack([x, np.ones_like(x)], 1)
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            g = a.T @ (each * (y - p)) - 0.1 * beta
            h = (a * (each * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
            step = np.linalg.solve(h, g)
            beta += step
            if np.abs(step).max() < 1e-8:
                break
        if beta[0] > 0:
            fitted.slope, fitted.bias = float(beta[0]), float(beta[1])
        return fitted


def train(spark: SparkSession, sf_dir: str) -> Toxicity:
    """Learns from labelled documents that aren't held out, FIT_TOXIC and FIT_CLEAN of them at most."""
    rows = labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", {1: FIT_TOXIC, 0: FIT_CLEAN})
    return Toxicity().fit(rows)


def score_documents(docs: DataFrame, model: Toxicity, keys: list[str]) -> DataFrame:
    """keys, score, predicted, n_hits, rate for every row."""

    def make():
        rate = model.rater()

        def one(text):
            r, hits, _ = rate(text)
            s = model.score(r)
            return s, int(s >= 0.5), hits, r

        return one

    return map_text(docs, keys, "text", make, "score double, predicted int, n_hits int, rate double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(spark, sf_dir), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits", "rate")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score of 0.5 or more).

    Null and empty texts stay, rows of equal texts stay or go together, other columns of any name pass unchanged; an empty
    table gives an empty table.
    """
    model = train(spark, sf_dir)

    def make():
        rate = model.rater()
        return lambda text: model.score(rate(text)[0]) < 0.5

    return keep_rows(docs, "text", make)
