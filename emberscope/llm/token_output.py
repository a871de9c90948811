"""Token ids of documents in binary files, with Elias-Fano coded document boundaries.

Documents are ordered by id over range partitions. Each partition becomes files of at most
``file_tokens`` ids (more only for one longer document):

    "TIDS" version ids-width  | n documents | n ids | Elias-Fano boundaries (0, end of each document) |
    ids, little-endian, 2 or 4 bytes each | document ids, 8 bytes each, and a byte each: 1 for null

Boundaries count ids within the file; a file's own offset is in the manifest, a
table with a row for each file. A file is written under a name of its task attempt and
then moved to its final name, so a repeated task replaces whole files by equal ones.

Null texts are empty: they hold only the end id. Null ids come first. Documents with equal ids
stand next to each other in any order. An empty table gives an empty manifest.

Words between ASCII white space are encoded one by one by the tokenizers library and kept
in a cache that is cut back to the words in use. The tokenizer must not join ids over white space, which is verified on
its description (``splits_at_space``); otherwise whole texts are encoded.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.session import fresh_dir

from .common import WORD, chunks, ship
from .eliasfano import EliasFano, encode

MAGIC = b"TIDS"
HEAD = struct.Struct("<4sHHQQQ")
CACHE_WORDS = 1_200_000
FILE_TOKENS = 4 << 20
_PUNCTUATION = ".,;:!?"
#: What str.split() takes for white space beyond the ASCII kind.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_between(text: str) -> list[str]:
    """Words between ASCII white space."""
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def splits_at_space(description: dict) -> bool:
    """Whether the tokenizer drops white space before it forms ids, so that words are independent."""
    steps = description.get("normalizer") or {}
    steps = steps.get("normalizers", [steps])
    if any(s.get("type") not in ("NFC", "Lowercase", "Replace") for s in steps):
        return False
    if any(s["type"] == "Replace" and (s["pattern"] != {"Regex": "\\s+"} or s["content"] != " ") for s in steps):
        return False
    pre = description.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    first = parts[0]
    # a pattern kept by what it matches, none of whose branches matches white space
    drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
    drops = drops and first["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    rest = all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in parts[1:])
    plain = all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in description.get("added_tokens", []))
    return bool(drops and rest and plain and not description.get("post_processor"))


class Encoder:
    """Ids of whole texts as little-endian bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            description = json.load(f)
        self.by_word = splits_at_space(description)
        self.lower = any(s.get("type") == "Lowercase" for s in (description.get("normalizer") or {}).get("normalizers", []))
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}
        suffix = description["model"].get("end_of_word_suffix")
        # ids that close a word, if the vocabulary tells them apart
        self.closes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        if suffix:
            self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.type) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: set[str]) -> dict[str, tuple[str, ...]]:
        """Parts of each word that are encoded alone: letters, and the punctuation after them, never form an id together."""
        out, lower = {}, self.lower
        for word in words:
            stem = word.rstrip(_PUNCTUATION)
            if not stem.isalpha():
                out[word] = (word,)
            else:
                own = stem.lower() if lower and stem.isascii() else stem
                out[word] = (own,) if len(stem) == len(word) else (own, word[len(stem) :])
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces; words of letters are encoded many in one text and cut where a word closes."""
        out: dict[str, bytes] = {}
        letters = [p for p in pieces if p.isalpha()] if self.closes.any() else []
        groups = [letters[i : i + 1000] for i in range(0, len(letters), 1000)]
        width = self.type.itemsize
        for group, ids in zip(groups, self._texts([" ".join(g) for g in groups])):
            cuts = ((np.flatnonzero(self.closes[ids]) + 1) * width).tolist()
            if len(cuts) == len(group) and (not len(ids) or cuts[-1] == len(ids) * width):
                raw = ids.tobytes()
                out.update(zip(group, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
        rest = [p for p in pieces if p not in out]
        out.update(zip(rest, (ids.tobytes() for ids in self._texts(rest))))
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return [ids.tobytes() for ids in self._texts([t or "" for t in texts])]
        words = [words_between(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            seen = set().union(*words)
            self.cache = {w: self.cache[w] for w in seen if w in self.cache}
        cache = self.cache
        parts = self._pieces(set(filterfalse(cache.__contains__, chain.from_iterable(words))))
        pieces = set(chain.from_iterable(parts.values()))
        ids = {p: cache[p] for p in pieces if p in cache}
        fresh = self._learn({p for p in pieces if p not in ids})
        ids |= fresh
        cache |= fresh
        for w, own in parts.items():
            cache[w] = ids[own[0]] if len(own) == 1 else ids[own[0]] + ids[own[1]]
        of = cache.__getitem__
        return [b"".join(map(of, own)) for own in words]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def file_bytes(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    ends = np.concatenate([[0], np.cumsum([len(b) // width for b in ids])]).astype(np.uint64)
    bounds = encode(ends)
    head = HEAD.pack(MAGIC, 1, width, len(ids), int(ends[-1]), len(bounds))
    nulls = bytes(d is None for d in doc_ids)
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    return b"".join([head, bounds, *ids, names, nulls])


class TokenFile:
    """A file's bytes: any document's ids by two selects."""

    def __init__(self, data: bytes):
        magic, version, width, self.n, self.n_ids, size = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        at = HEAD.size
        self.bounds = EliasFano(data[at : at + size])
        at += size
        self.ids = np.frombuffer(data, dtype=f"<u{width}", count=self.n_ids, offset=at)
        at += self.n_ids * width
        self.names = np.frombuffer(data, dtype="<i8", count=self.n, offset=at)
        self.nulls = np.frombuffer(data, dtype=np.uint8, count=self.n, offset=at + 8 * self.n)

    def __len__(self) -> int:
        return self.n

    def doc_id(self, i: int) -> int | None:
        return None if self.nulls[i] else int(self.names[i])

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def _put(folder: str, name: str, data: bytes) -> None:
    files, base = _filesystem(folder)
    files.create_dir(base, recursive=True)
    temporary = f"{base}/_{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    files.move(temporary, f"{base}/{name}")


def _get(path: str) -> bytes:
    files, at = _filesystem(path)
    with files.open_input_stream(at) as f:
        return f.read()


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Write the files and return the manifest: (file, n_docs, n_ids, start), in order of ``file``.

    ``folder`` is one that all executors reach; by default a new one below the
    cluster's shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_dir(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    # 64-bit ids must not become floating-point numbers
    ordered = ordered.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoding, part = encoder(tokenizer), TaskContext.get().partitionId()
        width, end = encoding.type.itemsize, np.array([end_id], dtype=encoding.type).tobytes()
        names, ids, held, k = [], [], 0, 0

        def flush() -> pd.DataFrame:
            name = f"part-{part:06d}-{k:06d}.tids"
            _put(folder, name, file_bytes(names, ids, width))
            return pd.DataFrame({"file": [name], "n_docs": [len(ids)], "n_ids": [held]})

        for frame in parts:
            texts = frame["text"].tolist()
            coded = (b for x, y in chunks(texts) for b in encoding.encode_all(texts[x:y]))
            for d, none, b in zip(frame["doc_id"], frame["none"], coded):
                b += end
                if ids and held + len(b) // width > file_tokens:
                    yield flush()
                    names, ids, held, k = [], [], 0, k + 1
                names.append(None if none else int(d))
                ids.append(b)
                held += len(b) // width
        if ids:
            yield flush()

    written = ordered.mapInPandas(write, "file string, n_docs long, n_ids long")
    manifest_path = fresh_dir(spark, "manifest")
    written.write.parquet(manifest_path)
    files = spark.read.schema("file string, n_docs long, n_ids long").parquet(manifest_path)
    # a row for each file of millions of ids; the partitions' totals first, then a running sum inside each
    return _with_starts(files).withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


def _with_starts(files: DataFrame) -> DataFrame:
    """The ids before each file: a running sum within a partition's files, and one over partitions."""
    from pyspark.sql import Window

    part = F.substring("file", 6, 6)
    within = Window.partitionBy(part).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    inner = files.withColumns({"part": part, "inner": F.coalesce(F.sum("n_ids").over(within), F.lit(0))})
    totals = files.groupBy(part.alias("part")).agg(F.sum("n_ids").alias("n"))
    # a row for each partition of the job
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return inner.join(totals, "part").select("file", "n_docs", "n_ids", (F.col("base") + F.col("inner")).alias("start"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document from the files: (doc_id, start, n_tokens, ids_crc32), by the files' boundaries."""
    spark: SparkSession = manifest.sparkSession
    ship(spark)

    def back(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, start in zip(part["file"], part["start"]):
                f = TokenFile(_get(path))
                for a in range(0, len(f), 4096):
                    b = min(a + 4096, len(f))
                    ends = f.bounds.values(a, b + 1)
                    yield pd.DataFrame({
                        "doc_id": pd.array([f.doc_id(i) for i in range(a, b)], dtype="Int64"),
                        "start": start + ends[:-1],
                        "n_tokens": np.diff(ends),
                        "ids_crc32": [zlib.crc32(f.ids[x:y].astype("<u4").tobytes()) for x, y in zip(ends[:-1], ends[1:])],
                    })

    spread = manifest.select("file", "start").repartition("file")
    return spread.mapInPandas(back, "doc_id long, start long, n_tokens long, ids_crc32 long")
