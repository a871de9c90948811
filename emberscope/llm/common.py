"""Helpers that several operators share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(column, UPPER, LOWER)


def lower_text(text: str) -> str:
    """A-Z in lower case, all else unchanged."""
    if text.isascii():
        return text.lower()
    # bytes of other characters are never those of A-Z
    return text.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).decode("utf-8", "surrogatepass")


def remainder(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % n


def text_remainder(key, n: int) -> int | None:
    return None if key is None else zlib.crc32(str(key).encode()) % n


# --- words as numbers --------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
_ODD = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ODD, -1, 1 << 64)
#: Bytes hashed in one step.
_BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, one after the other, and where each text begins.

    The second array has one entry more than there are texts. Null has no words.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(raw) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    ends_of_text = np.cumsum([len(r) + 1 for r in raw])
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        if end < len(data) and not _SPACE[data[end - 1]]:  # a block ends behind a word
            space = _SPACE[data[at:end]]
            last = np.flatnonzero(space)
            while not len(last):
                begin, end = end, min(end + _BLOCK, len(data))
                last = np.flatnonzero(_SPACE[data[begin:end]]) + begin - at
            end = at + int(last[-1]) + 1
        s, h = _block_hashes(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    bounds = np.searchsorted(np.concatenate(starts), np.concatenate([[0], ends_of_text]))
    return np.concatenate(hashes), bounds


def _block_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of a piece of text that ends with white space."""
    space = _SPACE[data]
    before = np.empty(len(space), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    # sum of byte codes times odd powers; the power of the first byte is divided out again
    total = np.cumsum(_BYTE[data] * powers(_ODD, len(data)))
    first = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return starts, mix((total[ends - 1] - first) * powers(_INV, len(data))[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: list, size: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts with about ``size`` characters each, to bound the memory of a step."""
    out, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size:
            out.append((begin, i + 1))
            begin, held = i + 1, 0
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by the place of its first word."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(_ODD) + words[i : i + len(out)]
    return mix(out)
