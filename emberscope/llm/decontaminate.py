"""Benchmark decontamination by one Aho-Corasick automaton over the test items.

Items and documents are normalised alike: A-Z in lower case, words are runs of
a-z, 0-9 and anything beyond ASCII. An item's patterns are its runs of ten words,
or the whole item if it has fewer. All patterns form one automaton over word numbers;
a document is scanned once, and matches lead back from word numbers to places in the original text.
Words are compared by 64-bit hashes.

The automaton is a few flat arrays: the edges, sorted by state and word, and the failure and output links. A pattern takes
ten states at most, of some thirty bytes. It
grows with the benchmark, not with the corpus, and its size is
checked: a benchmark of more than ``block_bytes`` of text is cut into blocks of whole items, each
an automaton of its own, and the documents are scanned for one block after the other, so that a worker never holds two. Many
texts are scanned side by side, long ones in pieces that overlap by nine words.

Null texts have no words. Items without words and items with a null id are ignored;
an id that occurs in several rows has the windows of all of them. Repeated
documents are reported once for each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.session import Scratch

from .common import chunks, free_name, ship, word_hashes

WINDOW = 10
#: Text of the items of one automaton, and characters of documents scanned side by side.
BLOCK_BYTES, CHUNK = 4 << 20, 4 << 20
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if _WORD_BYTE[c] else 0x20 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    """The patterns of an item, each in one piece."""
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def normalised(text: str | None) -> str | None:
    """The text in lower case, with a space for everything between words; bytes beyond ASCII stay as they are."""
    return None if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).decode("utf-8", "surrogatepass")


class Automaton:
    """An Aho-Corasick automaton over numbers from 1 on; a 0 occurs in no pattern.

    ``patterns`` holds a pattern in each row, ``lengths`` how much of the row it is. State 0 is the root; the states of a depth follow those
    of the depth before, so the edges come out sorted.
    """

    def __init__(self, patterns: np.ndarray, lengths: np.ndarray, alphabet: int):
        at = np.zeros(len(patterns), dtype=np.int64)
        keys, depth, self.ends = [], [np.zeros(1, dtype=np.int16)], at
        levels, count = [(0, 1)], 1
        for d in range(int(lengths.max(initial=0))):
            longer = np.flatnonzero(lengths > d)
            found, inverse = np.unique((at[longer] << 32) | patterns[longer, d], return_inverse=True)
            at[longer] = count + inverse
            keys.append(found)
            depth.append(np.full(len(found), d + 1, dtype=np.int16))
            levels.append((count, count + len(found)))
            count += len(found)
        #: Edge i leads to state i + 1.
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        self.depth = np.concatenate(depth)
        self.root = np.zeros(alphabet + 1, dtype=np.int32)
        if keys:
            self.root[keys[0]] = np.arange(1, len(keys[0]) + 1)
        self.terminal = np.zeros(count, dtype=bool)
        self.terminal[at] = True
        self.terminal[0] = False
        self.fail, self.link = np.zeros(count, dtype=np.int32), np.zeros(count, dtype=np.int32)
        for begin, end in levels[2:]:
            own = self.keys[begin - 1 : end - 1]
            self.fail[begin:end] = self.step(self.fail[own >> 32], own & 0xFFFFFFFF)
            f = self.fail[begin:end]
            self.link[begin:end] = np.where(self.terminal[f], f, self.link[f])

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states after one more symbol each."""
        out = self.root[symbols]
        open_ = np.flatnonzero((states > 0) & (symbols > 0))
        s = states[open_].astype(np.int64)
        while len(open_):
            key = (s << 32) | symbols[open_]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[i] == key
            out[open_[there]] = i[there] + 1
            s = self.fail[s[~there]].astype(np.int64)
            open_ = open_[~there][s > 0]  # from the root on, the edge of the root counts
            s = s[s > 0]
        return out

    def matches(self, symbols: np.ndarray, bounds: np.ndarray, piece: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(last place, terminal state) of every occurrence in texts that stand one after the other."""
        reach = max(0, int(self.depth.max()) - 1)
        n = np.diff(bounds)
        pieces = -(-n // piece)
        text = np.repeat(np.arange(len(n)), pieces)
        first = bounds[:-1][text] + piece * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        begin, end = np.maximum(first - reach, bounds[:-1][text]), np.minimum(first + piece, bounds[1:][text])
        order = np.argsort(begin - end, kind="stable")  # the longest first: those in use are a prefix
        begin, end, first = begin[order], end[order], first[order]
        size = end - begin
        states = np.zeros(len(begin), dtype=np.int32)
        places, found = [], []
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t, side="left"))
            at = begin[:live] + t
            states[:live] = s = self.step(states[:live], symbols[at])
            hit = np.flatnonzero((self.terminal[s] | (self.link[s] > 0)) & (at >= first[:live]))
            if len(hit):
                places.append(at[hit])
                found.append(s[hit])
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        place, state = np.concatenate(places), np.concatenate(found)
        every = [(place[self.terminal[state]], state[self.terminal[state]])]
        while len(place):
            state = self.link[state]
            place, state = place[state > 0], state[state > 0]
            every.append((place, state))
        return np.concatenate([p for p, _ in every]), np.concatenate([x for _, x in every])


class Scanner:
    """The automaton of the windows of (item id, text) pairs, and the items of each of its patterns."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        self.names = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        hashes, bounds = word_hashes([normalised(t) for _, t in items])
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        symbols = symbols.astype(np.int64) + 1
        n = np.diff(bounds)
        windows = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), windows)
        start = bounds[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        lengths = np.minimum(n[item], size)
        padded = np.concatenate([symbols, np.zeros(size, dtype=np.int64)])
        patterns = padded[start[:, None] + np.arange(size)[None, :]]
        self.automaton = Automaton(patterns, lengths, len(self.vocabulary))
        # items by terminal state, each once
        own = np.unique(np.stack([self.automaton.ends, np.array([number[items[i][0]] for i in item], dtype=np.int64)], axis=1), axis=0) if len(item) else np.zeros((0, 2), dtype=np.int64)
        self.states, self.items = own[:, 0], own[:, 1]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of the items' vocabulary, 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        i = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == hashes, i + 1, 0)

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """For each text: number of words, the numbers of those that are hit, and the items found."""
        hashes, bounds = word_hashes([normalised(t) for t in texts])
        place, state = self.automaton.matches(self.numbers(hashes), bounds)
        edge = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(edge, place - self.automaton.depth[state] + 1, 1)
        np.add.at(edge, place + 1, -1)
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        cuts = np.searchsorted(hit, bounds)
        # pairs of text and item
        text = np.searchsorted(bounds, place, side="right") - 1
        pairs = np.unique(np.stack([text, state.astype(np.int64)], axis=1), axis=0)
        low, high = np.searchsorted(self.states, pairs[:, 1], side="left"), np.searchsorted(self.states, pairs[:, 1], side="right")
        found: dict[int, set[str]] = {}
        for k, a, b in zip(pairs[:, 0], low, high):
            found.setdefault(int(k), set()).update(self.names[i] for i in self.items[a:b])
        for k in range(len(texts)):
            yield int(bounds[k + 1] - bounds[k]), hit[cuts[k] : cuts[k + 1]] - bounds[k], sorted(found.get(k, ()))


def original_spans(text: str, places: np.ndarray, n_words: int) -> list[dict]:
    """Runs of hit words, given by their numbers, as places in the original text, in characters: begin, end (exclusive)."""
    if not len(places):
        return []
    hit = np.zeros(n_words, dtype=bool)
    hit[places] = True
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_TABLE), dtype=np.uint8)
    inside = np.concatenate([[False], raw != 0x20, [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begin, end = starts[np.flatnonzero(edge == 1)], ends[np.flatnonzero(edge == -1) - 1]
    encoded = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    chars = np.concatenate([[0], np.cumsum((encoded & 0xC0) != 0x80)])
    return [{"begin": int(chars[b]), "end": int(chars[e])} for b, e in zip(begin, end)]


_SCHEMA = "n_words long, hits array<int>, spans array<struct<begin:long,end:long>>, items array<string>"

def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, one block at a time on the driver."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    items = items.filter(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r.item, r.text) for r in part.collect()]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with n_words, hit_words (their numbers), hit_spans and items (ids as text, sorted).

    Columns of ``docs`` with a name of the result are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    made = ("n_words", "hit_words", "hit_spans", "items")
    kept = [c for c in docs.columns if c.lower() not in made]
    out, scratch, last = None, Scratch(spark), None
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        items = spark.sparkContext.broadcast(block)

        @F.pandas_udf(_SCHEMA)
        def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            scanner = Scanner(items.value, size)
            for texts in parts:
                rows, texts = [], texts.tolist()
                for a, b in chunks(texts, CHUNK):
                    own = texts[a:b]
                    rows += [(n, hit, original_spans(t, hit, n), ids) for t, (n, hit, ids) in zip(own, scanner.scan(own))]
                yield pd.DataFrame(rows, columns=["n_words", "hits", "spans", "items"])

        own = free_name(docs, "__found")
        if out is None:
            out = docs.withColumn(own, found(F.col(text)))
            out = out.select(*kept, *([] if text in kept else [text]), F.col(f"{own}.n_words").alias("n_words"), F.col(f"{own}.hits").alias("hit_words"), F.col(f"{own}.spans").alias("hit_spans"), F.col(f"{own}.items").alias("items"))
        else:
            # the scan for the last block ends here, and its automaton with it
            done = scratch.put(out, "scanned")
            scratch.drop(last)
            out, last = done, done
            out = out.withColumn(own, found(F.col(text)))
            out = out.withColumns({
                "hit_words": F.array_sort(F.array_union("hit_words", F.col(f"{own}.hits"))),
                "hit_spans": F.array_sort(F.array_union("hit_spans", F.col(f"{own}.spans"))),
                "items": F.array_sort(F.array_union("items", F.col(f"{own}.items"))),
            }).drop(own)
    return out.select(*kept, *made)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The columns of the contract from the result of ``contamination``."""
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        F.col(doc_id).alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def items_sha256(ids) -> str:
    """For tests: the digest of a set of item ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
