"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is the product of its three
letters' vectors, the first rotated by two places and the second by one. A text is the
sum of its trigrams' vectors; a language's prototype is the sum over the texts known
to be in it, each text scaled by its number of trigrams. Texts and prototypes are
compared by cosine, after the mean of all prototypes is taken from both.

Every letter of every script has a vector of its own, made from its code point when it is first met. A text's vector is the product
of the counts of its distinct trigrams with their vectors, block by block, so neither a table of all trigrams nor a text's
length decides the memory. For training, tasks add up trigram weights by language, Spark sums them, and what is sent to the driver are
prototypes, so many numbers for each language.

Letters are lower-cased, marks belong to the letters before them, and a run of anything else is one gap. Texts that are null or have no letter
are ``und`` with score 0, as is everything if nothing was learned. Equal cosines go to the
language that sorts first. Rows with a null or empty language teach nothing.
The score is the cosine, with negative values as 0.

Which language is nearest says little about whether a text is in it: without the mean, some cosine is nearly always positive.
Whether a text is foreign is told by its product with the prototype, mean kept, for each trigram. A language's own
training texts give its mean and deviation; a text is foreign below LEAST_SHARE of the mean, less one
deviation over the root of the text's effective number of trigrams (the square of their number over the sum of the squared
counts), so that short texts and those that repeat a few words are not judged by chance.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.session import Scratch

from .common import free_name, ship

DIMENSIONS, SEED = 512, 7
UNKNOWN = "und"
#: Prototypes are DIMENSIONS numbers for each language; more languages than this are refused.
MAX_LANGUAGES = 4096
BATCH = 128
#: Trigrams whose vectors are made at once, and weights a task holds before it passes them on.
BLOCK, HELD = 8192, 1 << 20
#: Share of the training texts' mean product with their language that a long text must have.
LEAST_SHARE = 0.3
#: Bits of a code point.
_BITS = 21
_LETTER = (1 << _BITS) - 1


class _Space:
    """Vectors of letters, and the symbol of each character: its lower-case letter's code point, 0 for a gap."""

    def __init__(self) -> None:
        self.low = np.array([self._symbol(c) for c in range(0x3000)], dtype=np.int64)
        self.codes = np.zeros(1, dtype=np.int64)
        self._place(self._vector(0)[None, :])

    def _place(self, letters: np.ndarray) -> None:
        """Letters' vectors, and as they are in the first and second place of a trigram."""
        self.letters, self.first, self.second = letters, np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)

    @staticmethod
    def _symbol(code: int) -> int:
        c = chr(code).lower()[:1]
        return ord(c) if unicodedata.category(c)[0] in "LM" else 0

    @staticmethod
    def _vector(code: int) -> np.ndarray:
        return np.random.default_rng([SEED, code]).choice(np.array([-1, 1], dtype=np.int8), DIMENSIONS)

    def symbols(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        far = codes >= len(self.low)
        out = self.low[np.where(far, 0, codes)]
        if far.any():
            distinct, where = np.unique(codes[far], return_inverse=True)
            out[far] = np.array([self._symbol(int(c)) for c in distinct], dtype=np.int64)[where]
        return out

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams, each as the code points of its letters in one number, and their counts; null without a letter."""
        if not text:
            return None
        s = self.symbols(text)
        # a mark alone is no letter
        if not any(unicodedata.category(chr(c))[0] == "L" for c in s[s > 0].tolist()):
            return None
        s = np.concatenate([[0], s, [0]])
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)  # one gap for a run of them
        s = s[keep]
        return np.unique((s[:-2] << 2 * _BITS) | (s[1:-1] << _BITS) | s[2:], return_counts=True)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of some trigrams: the product of their letters', the first rotated by two places and the second by one."""
        parts = [grams >> 2 * _BITS, (grams >> _BITS) & _LETTER, grams & _LETTER]
        new = np.setdiff1d(np.unique(np.concatenate(parts)), self.codes)
        if len(new):
            codes = np.concatenate([self.codes, new])
            letters = np.concatenate([self.letters, np.stack([self._vector(int(c)) for c in new])])
            order = np.argsort(codes)
            self.codes = codes[order]
            self._place(letters[order])
        a, b, c = (np.searchsorted(self.codes, p) for p in parts)
        out = self.first[a]
        out *= self.second[b]
        out *= self.letters[c]
        return out.astype(np.float32)

    def sums(self, rows: np.ndarray, grams: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """For each of ``n`` rows the sum of its trigrams' vectors by weight; (row, trigram, weight) for each entry."""
        distinct, column = np.unique(grams, return_inverse=True)
        order = np.argsort(column, kind="stable")
        rows, column, weights = rows[order], column[order], weights[order]
        out = np.zeros((n, DIMENSIONS), dtype=np.float32)
        for at in range(0, len(distinct), BLOCK):
            low, high = np.searchsorted(column, [at, at + BLOCK])
            counts = np.zeros((n, min(BLOCK, len(distinct) - at)), dtype=np.float32)
            counts[rows[low:high], column[low:high] - at] = weights[low:high]
            out += counts @ self.vectors(distinct[at : at + BLOCK])
        return out


_space: list[_Space] = []


def space() -> _Space:
    if not _space:
        _space.append(_Space())
    return _space[0]


def trigram_shares(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, weight): over a language's texts, the sum of each trigram's share of its text. A table of its own."""
    spark = docs.sparkSession
    ship(spark)
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = known.filter(F.col("text").isNotNull() & (F.col("lang") != ""))

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged() -> Iterator[pd.DataFrame]:
            for language, pieces in held.items():
                grams, where = np.unique(np.concatenate([g for g, _ in pieces]), return_inverse=True)
                yield pd.DataFrame({"lang": language, "gram": grams, "weight": np.bincount(where, np.concatenate([w for _, w in pieces]))})

        for part in parts:
            for t, language in zip(part["text"], part["lang"]):
                found = space().trigrams(t)
                if found is not None:
                    held.setdefault(language, []).append((found[0], found[1] / found[1].sum()))
                    size += len(found[0])
                    if size >= HELD:
                        yield from merged()
                        held, size = {}, 0
        yield from merged()

    weights = known.mapInPandas(counted, "lang string, gram long, weight double")
    # in steps of 2**-40, so that the order of adding makes no difference
    steps = F.sum(F.round(F.col("weight") * float(1 << 40)).cast("decimal(38,0)"))
    scratch = Scratch(spark)
    return scratch.put(weights.groupBy("lang", "gram").agg(steps.cast("double").alias("weight")), "trigrams")


def _by_language(shares: DataFrame, work, width: int) -> dict[str, np.ndarray]:
    """Sums by language of what ``work`` makes of a language's trigrams and weights: ``width`` numbers each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for language, own in part.groupby("lang", sort=False):
                value = work(language, own["gram"].to_numpy(), own["weight"].to_numpy())
                sums[language] = sums.get(language, 0) + value
                if len(sums) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for language, value in sums.items():
            yield pd.DataFrame({"lang": language, "i": np.arange(width), "value": value})

    steps = F.sum(F.round(F.col("value")).cast("decimal(38,0)")).cast("double")
    found = shares.mapInPandas(run, "lang string, i int, value double").groupBy("lang", "i").agg(steps.alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in found.toLocalIterator():  # languages times width, whatever the corpus
        out.setdefault(r.lang, np.zeros(width))[r.i] = r.value
    if len(out) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {language: out[language] for language in sorted(out)}


def prototypes_of(shares: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes by language from ``trigram_shares``."""

    def work(_: str, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(DIMENSIONS)
        for at in range(0, len(grams), BLOCK):
            total += weights[at : at + BLOCK] @ space().vectors(grams[at : at + BLOCK]).astype(np.float64)
        return total

    return {language: (v / np.linalg.norm(v)).astype(np.float32) for language, v in _by_language(shares, work, DIMENSIONS).items()}


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language, from all rows of ``docs``."""
    return prototypes_of(trigram_shares(docs, text, lang))


def spreads_of(shares: DataFrame, prototypes: dict[str, np.ndarray]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of the product with its prototype over each language's trigrams."""
    model = shares.sparkSession.sparkContext.broadcast(prototypes)

    def work(language: str, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(3)
        for at in range(0, len(grams), BLOCK):
            own, w = space().vectors(grams[at : at + BLOCK]) @ model.value[language], weights[at : at + BLOCK]
            total += [w.sum(), w @ own, w @ (own * own)]
        return total

    out = {}
    for language, (n, first, second) in _by_language(shares, work, 3).items():
        mean = first / n
        out[language] = (mean, float(np.sqrt(max(0.0, second / n - mean * mean))))
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", spreads: dict[str, tuple[float, float]] | None = None) -> Column:
    """A column struct<lang_pred, score> over ``docs``' text; with ``spreads`` of all languages given, also whether it is foreign."""
    ship(docs.sparkSession)
    names = sorted(prototypes)
    limits = np.array([spreads[n] for n in names]).reshape(-1, 2) if spreads is not None else None
    model = docs.sparkSession.sparkContext.broadcast((names, np.array([prototypes[n] for n in names], dtype=np.float32)))

    @F.pandas_udf("lang_pred string, score double" + ("" if limits is None else ", foreign boolean"))
    def said(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, vectors = model.value
        raw = vectors
        if languages:
            mean = vectors.mean(axis=0) if len(languages) > 1 else np.zeros(DIMENSIONS, dtype=np.float32)
            vectors = vectors - mean
            vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        for texts in parts:
            best, score, foreign = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            rows = texts.tolist()
            for begin in range(0, len(rows) if languages else 0, BATCH):
                own = [(i, h) for i in range(begin, min(begin + BATCH, len(rows))) if (h := space().trigrams(rows[i])) is not None]
                if not own:
                    continue
                places = np.repeat(np.arange(len(own)), [len(g) for _, (g, _) in own])
                vec = space().sums(places, np.concatenate([g for _, (g, _) in own]), np.concatenate([c for _, (_, c) in own]), len(own))
                products = vec @ raw.T if limits is not None else None
                vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
                vec -= mean
                vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
                cosine = vec @ vectors.T
                for at, ((i, (_, h)), row) in enumerate(zip(own, cosine)):
                    k = int(np.argmax(row))
                    best[i], score[i] = languages[k], min(1.0, max(0.0, float(row[k])))
                    if limits is not None:
                        n, (usual, deviation) = float(h.sum()), limits[k]
                        foreign[i] = products[at, k] / n < LEAST_SHARE * usual - deviation * np.sqrt(float((h.astype(np.float64) ** 2).sum())) / n
            out = {"lang_pred": best, "score": score}
            yield pd.DataFrame(out if limits is None else out | {"foreign": foreign})

    return said(F.col(text))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    made = ("lang_pred", "score")
    kept = [c for c in docs.columns if c.lower() not in made]
    own = free_name(docs, "__said")
    out = docs.withColumn(own, predict(docs, prototypes, text))
    return out.select(*kept, *(F.col(f"{own}.{m}").alias(m) for m in made))
