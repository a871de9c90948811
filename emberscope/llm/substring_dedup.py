"""Removal of repeated passages, exact, by one FM-index for each shard of the corpus.

A word is removed if it lies in a window of 20 words whose words also start earlier: in a document with a smaller
id, or earlier in the same one. Windows are judged on the input.

Shards are cut by content, not by document, so that every document meets only the
shards that can hold its repeats. Each window is filed under its smallest run of six words (by hash; the leftmost of equal ones).
Neighbouring windows mostly share it: such a stretch is at most 15 windows, 34 words. Equal windows
have the same smallest run, so all copies of a window are in one shard, and a run seen once in the corpus needs no
index at all.

1. Documents are cut into stretches; runs are counted, and stretches of runs seen once are left out.
2. Equal stretches are aggregated to the earliest; the later ones are repeated as a whole.
3. The earliest ones' words go to the shard of their run. The shard's FM-index is built over them in order of
   (document, place), and they are streamed against it: matching statistics give each window's suffix interval,
   and the interval's earliest place decides.
4. Intervals of repeated windows return to their documents.

A run with very many different stretches (the edge of a passage that very many documents share) would fill one shard. Such
stretches are split into single windows first, and each window is a stretch of its own with its own key, which
step 2 aggregates; none is left out.

Null texts have no words. Rows with a null id neither lose words nor cause others to. Rows with equal ids and
equal texts are one document in two rows and lose the same words; with equal ids and unequal texts,
places count by (id, start) all the same. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.session import Scratch

from .common import _INV, _ODD, chunks, free_name, mix, powers, ship, window_hashes, word_hashes
from .fm_index import FMIndex

WINDOW, RUN = 20, 6
#: Words of a shard's index, about.
SHARD_WORDS = 1 << 19
#: Different stretches of one run beyond which they are split into windows.
CROWDED = 8192


def _smallest(h: np.ndarray, size: int) -> np.ndarray:
    """Place of the smallest value, leftmost if equal, of every ``size`` neighbours."""
    best, at, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < size:
        shift = min(have, size - have)
        left, right = slice(None, len(best) - shift), slice(shift, None)
        later = best[right] < best[left]
        at = np.where(later, at[right], at[left])
        best = np.where(later, best[right], best[left])
        have += shift
    return at


def stretches(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW, run: int = RUN) -> dict[str, np.ndarray]:
    """Of all documents in a row: document number, first word, number of windows, run hash, content hash."""
    runs = window_hashes(words, run)
    at = _smallest(runs, window - run + 1) if len(words) >= window else np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(len(at))
    whole = doc[: len(at)] == doc[window - 1 : window - 1 + len(at)]
    place, at = place[whole], at[whole]
    if not len(place):
        none = np.zeros(0, dtype=np.int64)
        return {"doc": none, "start": none, "n": none, "run": none.astype(np.uint64), "content": none.astype(np.uint64)}
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(place) != 1)])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(place)))
    begin, end = place[first], place[first] + n + window - 1
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * powers(_ODD, len(words)))])
    content = mix((total[end] - total[begin]) * powers(_INV, len(words))[begin] + n.astype(np.uint64))
    d = doc[begin]
    return {"doc": d, "start": begin - bounds[d], "n": n, "run": runs[at[first]], "content": content}


_STRETCH = "run long, content long, doc_id long, row int, start int, n int"


def _cut(window: int, run: int):
    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, ids, rows = part["text"].tolist(), part["doc_id"].to_numpy(), part["row"].to_numpy()
            for a, b in chunks(texts):
                s = stretches(*word_hashes(texts[a:b]), window, run)
                d = a + s["doc"]
                yield pd.DataFrame({"run": s["run"].view(np.int64), "content": s["content"].view(np.int64), "doc_id": ids[d], "row": rows[d], "start": s["start"].astype(np.int32), "n": s["n"].astype(np.int32)})

    return cut


def _fetch(window: int):
    """Words of a document's listed stretches; of crowded ones, every window's key instead."""

    def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["text"].tolist()
            for a, b in chunks(texts):
                words, bounds = word_hashes(texts[a:b])
                out = []
                for i, base in zip(range(a, b), bounds):
                    doc_id, row = part["doc_id"].iloc[i], part["row"].iloc[i]
                    for own_run, packed in zip(part["runs"].iloc[i], part["places"].iloc[i]):
                        start, n = int(packed) >> 32, (int(packed) & 0xFFFFFFFF) >> 1
                        begin = int(base) + start
                        own = words[begin : begin + n + window - 1]
                        if packed & 1:
                            keys = window_hashes(own, window).view(np.int64)
                            out += [(int(k), doc_id, row, start + j, None) for j, k in enumerate(keys)]
                        else:
                            out.append((own_run, doc_id, row, start, own.tobytes()))
                yield pd.DataFrame(out, columns=["run", "doc_id", "row", "start", "words"])

    return fetch


_COVER = "doc_id long, row int, begin int, end int"


def _search(window: int):
    """Shards one after the other (rows come sorted by shard, document and place): index, search, report."""

    def shard_cover(parts: list[pd.DataFrame]) -> pd.DataFrame:
        # a document that stands in several rows is indexed once
        rows = pd.concat(parts).drop_duplicates(["run", "doc_id", "row", "start"], ignore_index=True)
        lengths = np.array([len(w) // 8 for w in rows["words"]], dtype=np.int64)
        index = FMIndex(np.frombuffer(b"".join(rows["words"]), dtype=np.uint64), lengths, window)
        found, first, seq = index.earliest()
        ids, starts = rows["doc_id"].to_numpy(), rows["start"].to_numpy() - index.starts
        source = np.searchsorted(index.starts, first, side="right") - 1
        # equal places are those of equal ids with different texts
        earlier = (first < found) & ((ids[source] != ids[seq]) | (starts[source] + first != starts[seq] + found))
        hit = np.zeros(len(index.text) + 2, dtype=bool)
        hit[found[earlier] + 1] = True
        begin = np.flatnonzero(hit[1:] & ~hit[:-1])
        end = np.flatnonzero(hit[:-1] & ~hit[1:]) + window - 1
        seq = np.searchsorted(index.starts, begin, side="right") - 1
        shift = starts[seq]
        return pd.DataFrame({"doc_id": ids[seq], "row": rows["row"].to_numpy()[seq], "begin": begin + shift, "end": end + shift})

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, shard = [], None
        for part in parts:
            for value, own in part.groupby("shard", sort=False):
                if value != shard and held:
                    yield shard_cover(held)
                    held = []
                shard = value
                held.append(own)
        if held:
            yield shard_cover(held)

    return search


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN, shard_words: int = SHARD_WORDS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, row, begin, end): word places that repeated windows cover, unmerged.

    ``row`` is Spark's 32-bit hash of the text, which tells rows with equal ids apart.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = _rows(docs, doc_id, text)
    cut = rows.mapInPandas(_cut(window, run), _STRETCH)
    # as a table of its own, so that Spark can split a hot run in the join
    often = scratch.put(cut.groupBy("run").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("run"), "often")
    found = scratch.put(cut.join(often, "run"), "stretches")
    order = F.min(F.struct("doc_id", "start", "row")).alias("at")
    first = scratch.put(found.groupBy("run", "content", "n").agg(order), "first")
    later = found.join(first, ["run", "content", "n"]).filter("doc_id > at.doc_id OR doc_id = at.doc_id AND start > at.start")
    cover = later.select("doc_id", "row", F.col("start").alias("begin"), (F.col("start") + F.col("n") + (window - 1)).alias("end"))

    packed = scratch.put(first.groupBy("run").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "packed")
    listed = first.join(packed, "run").select("run", "at.doc_id", "at.row", "at.start", "n", (F.col("kinds") > crowded).alias("crowded"))
    # bounded by the length of the document
    place = F.shiftleft(F.col("start").cast("long"), 32) + F.col("n") * 2 + F.col("crowded").cast("int")
    listed = listed.groupBy("doc_id", "row").agg(F.collect_list(F.struct("run", place.alias("place"))).alias("list"))
    # arrays of numbers: a list of structs would be a dictionary for each in Python
    listed = rows.join(listed, ["doc_id", "row"]).select("doc_id", "row", "text", F.col("list.run").alias("runs"), F.col("list.place").alias("places"))
    fetched = scratch.put(listed.mapInPandas(_fetch(window), "run long, doc_id long, row int, start int, words binary"), "fetched")

    single = fetched.filter("words IS NULL")
    earliest = scratch.put(single.groupBy("run").agg(F.min(F.struct("doc_id", "start")).alias("at")), "earliest")
    again = single.join(earliest, "run").filter("doc_id > at.doc_id OR doc_id = at.doc_id AND start > at.start")
    cover = cover.unionByName(again.select("doc_id", "row", F.col("start").alias("begin"), (F.col("start") + window).alias("end")))

    indexed = fetched.filter("words IS NOT NULL")
    total = indexed.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, -(-total // (8 * shard_words)))
    dealt = indexed.withColumn("shard", F.pmod(F.xxhash64("run"), F.lit(shards)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "start", "row")
    cover = scratch.put(cover.unionByName(dealt.mapInPandas(_search(window), _COVER)), "cover")
    scratch.clear(cover)
    return cover


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("row", F.hash("text"))


def _without(words: list[bytes], spans: np.ndarray) -> list[bytes]:
    """The words in none of the spans, each a number of which the upper half is its begin and the lower its end."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, spans >> 32, 1)
    np.add.at(edge, spans & 0xFFFFFFFF, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN, shard_words: int = SHARD_WORDS, crowded: int = CROWDED) -> DataFrame:
    """``docs`` with kept (the words left, joined by a space), n_words, n_removed and kept_sha256; columns of these names are replaced."""
    made = ("kept", "n_words", "n_removed", "kept_sha256")
    others = [c for c in docs.columns if c.lower() not in made]
    cover = repeated_passages(docs, doc_id, text, window, run, shard_words, crowded)
    # bounded by the length of the document
    doc, row, spans_of = (free_name(docs, n) for n in ("__doc", "__row", "__spans"))
    span = F.shiftleft(F.col("begin").cast("long"), 32) + F.col("end")
    cover = cover.groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.collect_list(span).alias(spans_of))
    keep = docs.select(*others, *([] if text in others else [text]))
    joined = keep.join(cover, (keep[doc_id].cast("long") == cover[doc]) & (F.hash(keep[text]) == cover[row]), "left")

    @F.pandas_udf("kept string, n_words long, n_removed long, kept_sha256 string")
    def rest(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in parts:
            out = []
            for t, s in zip(texts, spans):
                # bytes.split() splits at ASCII white space only
                words = [] if t is None else t.encode("utf-8", "surrogatepass").split()
                left = words if s is None else _without(words, np.asarray(s, dtype=np.int64))
                joined_words = b" ".join(left)
                out.append((joined_words.decode("utf-8", "surrogatepass"), len(words), len(words) - len(left), hashlib.sha256(joined_words).hexdigest()))
            yield pd.DataFrame(out, columns=["kept", "n_words", "n_removed", "kept_sha256"])

    own = free_name(docs, "__rest")
    out = joined.withColumn(own, rest(F.col(text), F.col(spans_of)))
    return out.select(*others, *(F.col(f"{own}.{m}").alias(m) for m in made))
