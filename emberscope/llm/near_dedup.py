"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Shingles are runs of five words (A-Z lower-cased, split at ASCII white space), labelled with their
occurrence number, so that all of a document's are different. A document of fewer words, but not none, is
one shingle. An Order MinHash sketch takes the few shingles with the smallest hashes and keeps them in the
order of the text; two documents whose sketch agrees share these shingles in the same order, which favours
small edit distance over mere overlap.

Similarity is that of the best alignment that keeps order: the longest chain of common labelled shingles that
rise in both texts, over all shingles of both. Chains that could reach the threshold lie in a band around
the diagonal, and only that is searched. With shingles in the same order it is their Jaccard similarity.

A pair at the threshold of 0.8 agrees in a sketch of 6 with probability 0.26, in one of 32 with more than 0.9999.
Short documents get 16 sketches of 2 besides.

Candidates share a sketch. They are not compared pair by pair: everyone in a bucket is compared with its
smallest member, and links are joined into components. The documents of buckets that still hold several
components are then paired across components where they share one of their rarest shingles, without which they cannot
be similar. So every two similar members of a bucket are in one component in the end, and no link is lost.

Equal texts are one node from the start; rows with the same id are one document. Documents with a null id, a null text or
no word are alone. Words are compared by 32-bit hashes in the alignment.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope.session import Scratch

from .common import chunks, free_name, lower_text, mix, ship, window_hashes, word_hashes
from .components import components

WORDS, SIMILARITY = 5, 0.8
TAKE, SKETCHES = 6, 32
SHORT, SHORT_TAKE, SHORT_SKETCHES = 30, 2, 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Each shingle's hash joined with how often it occurred before."""
    n = len(shingles)
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if n else np.zeros(0, dtype=bool)
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    times = np.empty(n, dtype=np.uint64)
    times[order] = (np.arange(n) - begin).astype(np.uint64)
    return mix(shingles + times * _GOLD)


def shingles_of(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    if 0 < len(words) < size:
        size = len(words)
    return labelled(window_hashes(words, size))


def sketches(x: np.ndarray, take: int, number: int, salt: int) -> np.ndarray:
    """Order MinHash sketches of labelled shingles, each as one hash."""
    n, out = len(x), np.empty(number, dtype=np.uint64)
    seeds = mix(np.arange(1, number + 1, dtype=np.uint64) + np.uint64(salt * int(_GOLD) & _ALL))
    if n <= take:
        chosen = np.broadcast_to(np.arange(n), (number, n))
        return _fold(x[chosen], seeds)
    step = max(1, (1 << 17) // n)
    for a in range(0, number, step):
        s = seeds[a : a + step, None]
        h = (x[None, :] ^ s) * (s | np.uint64(1))
        places = np.sort(np.argpartition(h, take - 1, axis=1)[:, :take], axis=1)
        out[a : a + step] = _fold(x[places], seeds[a : a + step])
    return out


def _fold(rows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    h = seeds.copy()
    for i in range(rows.shape[1]):
        h = mix(h * _GOLD + rows[:, i])
    return h


def chain(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Similarity of two documents' labelled shingles, or 0.0 where it is surely below ``similarity``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < similarity * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    # a chain that suffices leaves so many shingles over at most, which bounds how far it strays
    band = (n + m) * (1 - similarity) / (1 + similarity)
    near = np.abs(i - j) <= band + 1e-9
    i, j = i[near], j[near]
    if len(i) < similarity * (n + m - len(i)):
        return 0.0
    j = j[np.argsort(i)]
    common = len(j)
    if (np.diff(j) < 0).any():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        common = len(tails)
    return common / (n + m - common)


def _hashed(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Ids of some documents and the 32-bit hashes of their words."""
    for part in parts:
        texts, ids = part["text"].tolist(), part["doc_id"].to_numpy()
        for a, b in chunks(texts):
            words, bounds = word_hashes([lower_text(t) for t in texts[a:b]])
            words = words.astype("<u4")
            yield ids[a:b], [words[x:y] for x, y in zip(bounds[:-1], bounds[1:])]


def _sketch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for ids, documents in _hashed(parts):
        keys = []
        for words in documents:
            x = shingles_of(words.astype(np.uint64))
            if not len(x):
                keys.append(np.zeros(0, dtype=np.int64))
                continue
            own = sketches(x, TAKE, SKETCHES, 1)
            if len(x) <= SHORT:
                own = np.concatenate([own, sketches(x, SHORT_TAKE, SHORT_SKETCHES, 2)])
            keys.append(own.view(np.int64))
        yield pd.DataFrame({"doc_id": ids, "keys": keys})


def _words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for ids, documents in _hashed(parts):
        yield pd.DataFrame({"node": ids, "words": [w.tobytes() for w in documents]})


def _verifier(similarity: float):
    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, x = None, None
        for part in parts:
            score = np.empty(len(part))
            for k, (a, b) in enumerate(zip(part["wa"], part["wb"])):
                if a != last:
                    last, x = a, shingles_of(np.frombuffer(a, dtype="<u4").astype(np.uint64))
                score[k] = chain(x, shingles_of(np.frombuffer(b, dtype="<u4").astype(np.uint64)), similarity)
            yield pd.DataFrame({"a": part["a"], "b": part["b"], "similarity": score})

    return verify


def _sharing_rare(documents: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different parts that share one of their rarest shingles; no similar pair is missing.

    Sets of n and m elements with this similarity have at least c = similarity / (1 + similarity) * (n + m) in common. In any
    order common to all, the first of these is at place n - c + 1 of the one and m - c + 1 of the other at most, and c is no
    less than similarity * n. In order of rising frequency these are shingles that hardly any other document has.
    """

    def shingled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for node, own, words in zip(part["node"], part["part"], part["words"]):
                x = shingles_of(np.frombuffer(words, dtype="<u4").astype(np.uint64))
                yield pd.DataFrame({"token": x.view(np.int64), "node": node, "part": own, "n": len(x)})

    tokens = scratch.put(documents.select("node", "part", "words").mapInPandas(shingled, "token long, node long, part long, n long"), "tokens")
    often = scratch.put(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "often")
    # a shingle of one document is in no pair, but takes its place among the rarest
    ranked = tokens.join(often, "token", "left").withColumn("times", F.coalesce("times", F.lit(1)))
    # bounded by the length of the document
    place = F.row_number().over(Window.partitionBy("node").orderBy("times", "token"))
    first = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9)) + 1
    prefix = ranked.withColumn("place", place).filter((F.col("place") <= first) & (F.col("times") > 1)).select("token", "node", "part", "n", "place")
    # A shingle that a template lends to very many documents must not pair them all. With c in common, a document of n shingles whose
    # shingle stands at this place can only be like documents of up to (n - place + 1) * (1 + similarity) / similarity - n
    # shingles, and of similarity * n at least: each row goes to the bands of such lengths, and meets there only rows that come to its own.
    shortest = F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9))
    longest = F.floor((F.col("n") - F.col("place") + 1) * F.lit((1 + similarity) / similarity) + F.lit(1e-9)) - F.col("n")
    wanted = F.sequence(_band(shortest), _band(F.greatest(longest, shortest)))
    prefix = prefix.filter(longest >= shortest).withColumns({"own": _band(F.col("n")), "wanted": F.explode(wanted)})
    prefix = scratch.put(prefix, "prefix")
    # only where several parts meet, and both bands have rows: what one part shares with itself alone is settled
    low, high = F.least("own", "wanted"), F.greatest("own", "wanted")
    meeting = prefix.groupBy("token", low.alias("low"), high.alias("high")).agg(F.min("part").alias("a"), F.max("part").alias("b"), F.min("own").alias("least"), F.max("own").alias("most"))
    meeting = meeting.filter("a < b AND least = low AND most = high")
    meeting = scratch.put(meeting.select("token", "low", "high"), "meeting")
    prefix = prefix.withColumns({"low": low, "high": high}).join(meeting, ["token", "low", "high"], "left_semi").drop("low", "high")
    prefix = scratch.put(prefix, "met")
    other = prefix.select("token", F.col("wanted").alias("own"), F.col("own").alias("wanted"), *[F.col(c).alias(f"b_{c}") for c in ("part", "n", "place")], F.col("node").alias("b"))
    once = "part <> b_part AND (own < wanted OR own = wanted AND a < b)"
    near = prefix.withColumnRenamed("node", "a").join(other, ["token", "own", "wanted"]).filter(once)
    common = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("b_n")) - F.lit(1e-9))
    near = near.filter((F.col("place") <= F.col("n") - common + 1) & (F.col("b_place") <= F.col("b_n") - common + 1))
    return scratch.put(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


#: Ratio of the lengths at the ends of a band.
BAND = 1.03


def _band(length: Column) -> Column:
    """The band a length lies in; longer texts never lie in an earlier one."""
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / F.lit(math.log(BAND))).cast("int")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) for each row: the smallest id of the documents it is linked with, directly or not."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    whole = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    named = whole.select("doc_id", F.md5(F.col("text").cast("binary")).alias("content"))
    first = scratch.put(named.groupBy("content").agg(F.min("doc_id").alias("node")), "first")
    # equal texts, and then rows with the same id, are one node
    members = scratch.put(named.join(first, "content").select("doc_id", "node").distinct(), "members")
    nodes = members.filter("doc_id = node").select("node").distinct()

    sketched = whole.mapInPandas(_sketch, "doc_id long, keys array<long>")
    sketched = scratch.put(sketched.join(nodes, F.col("doc_id") == F.col("node"), "left_semi"), "sketches")
    keyed = sketched.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # as a table of its own, so that Spark can split a hot key in the join
    shared = scratch.put(shared, "shared")
    buckets = scratch.put(keyed.join(shared, "key"), "buckets")
    wanted = buckets.select("node").distinct()
    words = whole.join(wanted, F.col("doc_id") == F.col("node"), "left_semi").mapInPandas(_words, "node long, words binary")
    words = scratch.put(words, "words")

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
        both = left.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
        scored = both.select("a", "b", "wa", "wb").mapInPandas(_verifier(similarity), "a long, b long, similarity double")
        return scratch.put(scored, "verified")

    def pair(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    done = verified(buckets.filter("node <> leader").select(*pair("leader", "node")).distinct())
    links = done.filter(F.col("similarity") >= similarity).select("a", "b")
    # an id that stands for several texts ties them together
    tied = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("top")).filter("a < top")
    tied = members.join(tied, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    labels = components(links.unionByName(tied), scratch)
    placed = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("part"))
    parts = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n"))
    # in a bucket of two, the only pair was compared
    parts = scratch.put(parts.filter("low < high AND n > 2").select("key"), "parts")
    rest = scratch.put(placed.join(parts, "key").select("node", "part").distinct(), "rest")
    if not rest.isEmpty():
        pairs = _sharing_rare(words.join(rest, "node"), similarity, scratch)
        more = verified(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"))
        links = more.filter(F.col("similarity") >= similarity).select("a", "b")
        known = labels.select(F.col("label").alias("a"), F.col("node").alias("b"))
        labels = components(known.unionByName(links), scratch)
    classes = members.join(labels, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("class_id"))
    out = rows.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    out = scratch.put(out, "classes")
    scratch.clear(out)
    return out


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class of texts: the one with the smallest id.

    Texts, not ids, are classed, so a text goes only if one like it stays: rows with the same id and unlike texts all stay, and of
    rows with the same id and text one. Of several texts with the smallest id of their class one stays. Rows with a null id or a null text all stay.
    """
    node, class_id, best, rank = (free_name(docs, n) for n in ("__node", "__class", "__best", "__rank"))
    alone = F.col(doc_id).isNull() | F.col(text).isNull()
    keyed = docs.withColumn(node, F.when(~alone, F.xxhash64(text)))
    scratch = Scratch(docs.sparkSession)
    # copies are made one; a text has its smallest id as its number, which puts originals into the middle of stars, or a hash where texts share that id
    texts = keyed.filter(~alone).groupBy(node, F.col(text).alias("text")).agg(F.min(F.col(doc_id).cast("long")).alias("low"))
    texts = scratch.put(texts, "texts")
    shared = texts.groupBy("low").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    numbered = texts.join(shared, "low", "left").select(node, "text", F.when(F.col("times").isNull(), F.col("low")).otherwise(F.col(node)).alias("doc_id"))
    numbered = scratch.put(numbered, "numbered")
    scratch.drop(texts)
    found = near_duplicates(numbered.select("doc_id", "text"), similarity=similarity).distinct()
    classes = scratch.put(numbered.select(node, "doc_id").join(found, "doc_id").select(node, F.col("class_id").alias(class_id)), "numbers")
    scratch.drop(numbered)
    held = keyed.filter(~alone).select(F.col(doc_id).alias("id"), node).join(classes, node)
    kept = held.groupBy(class_id).agg(F.min(F.struct(F.col("id"), F.col(node))).alias(best)).select(F.col(f"{best}.id").alias(best), F.col(f"{best}.{node}").alias(node))
    # a table of its own: rows of a very common document are split in the join
    kept = scratch.put(kept, "kept")
    stay = keyed.filter(~alone).join(kept, (keyed[doc_id] == kept[best]) & (keyed[node] == kept[node]), "left_semi")
    first = F.row_number().over(Window.partitionBy(doc_id, node).orderBy(F.lit(1)))
    stay = stay.withColumn(rank, first).filter(F.col(rank) == 1).select(*docs.columns)
    return stay.unionByName(docs.filter(alone))
