"""Document fingerprints by SimHash, and a search for all fingerprints within a Hamming radius.

A term is a piece of a word and the piece behind it, joined by a space; words are cut into pieces of 16 code
points. A term weighs as much as its first piece has code points and hashes to 128 bits (twice xxhash64). Every bit of the fingerprint
is voted on by all terms of the text with their weights, for or against; a tie is a 0. Texts whose term vectors
stand at an angle a differ in about 128 * a / pi bits, so the likeness of two fingerprints is the cosine that
their distance stands for.

For the search, fingerprints are cut into ``radius + keep`` blocks. At most ``radius`` of them can differ, so two
fingerprints within the radius agree in ``keep`` blocks at least: there is a table for every choice of ``keep`` blocks, permuted to
the front as the key, and what meets in any table is compared in full. No fingerprint within the radius is missed.

Only DataFrame functions: no Python on the way. Terms are counted where the text is read, and a text leaves its task as one row
of votes. Rows that repeat a text, or an id and its text, are made one before, map-side first.

A null text is an empty one. A text without words has the fingerprint of 128 zeros. Equal texts have equal
fingerprints. Upper-case A-Z count as lower-case. Very long texts need memory for their own pieces only.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope.session import Scratch

from .common import free_name, lower_ascii

BITS, PIECE = 128, 16
#: Hexadecimal digits of a fingerprint.
DIGITS = BITS // 4
_GAP, _LETTER = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _halves(fingerprint: Column) -> list[Column]:
    """The two signed numbers with the bits of a fingerprint."""
    return [F.conv(F.substring(fingerprint, at, 16), 16, -10).cast("long") for at in (1, 17)]


def distance(a: Column, b: Column) -> Column:
    """Number of bits in which two fingerprints differ."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_halves(a), _halves(b), strict=True)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the distance of two fingerprints stands for, with six digits; 0 from half the bits on."""
    return F.round(F.greatest(F.lit(0.0), F.cos(F.lit(math.pi) * distance(a, b) / BITS)), 6)


def _vote(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys..., fingerprint) of texts that each have keys of their own."""
    bare = F.trim(lower_ascii(F.coalesce(F.col(text), F.lit(""))))
    # a space behind every 16 code points of a longer word
    bare = F.when(bare.rlike(rf"{_LETTER}{{{PIECE + 1}}}"), F.regexp_replace(bare, rf"({_LETTER}{{{PIECE}}})(?={_LETTER})", "$1 ")).otherwise(bare)
    cut = texts.select(*keys, F.split(bare, _GAP).alias("__piece"))
    cut = cut.withColumn("__behind", F.slice("__piece", 2, F.greatest(F.size("__piece"), F.lit(1))))
    terms = cut.select(*keys, F.explode(F.arrays_zip("__piece", "__behind")).alias("__pair"))
    piece, behind = F.col("__pair.__piece"), F.coalesce(F.col("__pair.__behind"), F.lit(""))
    voters = terms.select(*keys, F.length(piece).cast("long").alias("__weight"), F.xxhash64(F.concat(piece, F.lit(" "), behind)).alias("__h0"))
    voters = voters.withColumn("__h1", F.xxhash64("__h0"))
    # two counters of 32 bits in each sum: a text weighs less than 2**31, as Spark's strings are shorter
    pair = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned(h, b).bitwiseAND(pair) * F.col("__weight")).alias(f"{h_name}_{b}") for h_name, h in (("__h0", F.col("__h0")), ("__h1", F.col("__h1"))) for b in range(32)]
    voted = voters.groupBy(*keys).agg(F.sum("__weight").alias("__all"), *sums)

    def bit(half: int, place: int) -> Column:
        both = F.col(f"__h{half}_{place % 32}")
        votes = F.shiftrightunsigned(both, 32) if place >= 32 else both.bitwiseAND(F.lit((1 << 32) - 1))
        return votes * 2 > F.col("__all")

    def digit(half: int, top: int) -> Column:
        return F.lower(F.hex(sum((F.when(bit(half, top - i), 8 >> i).otherwise(0) for i in range(4)), F.lit(0))))

    digits = [digit(h, top) for h in (0, 1) for top in range(63, -1, -4)]
    return voted.select(*keys, F.concat(*digits).alias("fingerprint"))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column fingerprint, which replaces one of that name. Each distinct text is looked at once."""
    kept = [c for c in docs.columns if c.lower() != "fingerprint"]
    own = free_name(docs, "__own")
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text")).distinct()
    prints = _vote(texts.select("__text", _text_key(F.col("__text")).alias(own)), "__text", [own])
    keyed = docs.select(*kept, _text_key(F.coalesce(F.col(text), F.lit(""))).alias(own))
    return keyed.join(prints, own).select(*kept, "fingerprint")


def within(queries: DataFrame, prints: DataFrame, radius: int, keep: int = 2, column: str = "fingerprint") -> DataFrame:
    """(query, fingerprint, distance): for each distinct fingerprint of ``queries`` all distinct ones of ``prints`` within the radius.

    A fingerprint finds itself where both tables hold it. Nulls find and are found by nothing.
    """
    blocks = radius + keep
    if not 0 <= radius or keep < 1 or blocks > DIGITS:
        raise ValueError(f"radius and keep must make at most {DIGITS} blocks")
    bounds = [i * DIGITS // blocks for i in range(blocks + 1)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        seen = df.select(F.col(column).alias(name)).filter(F.col(name).isNotNull()).distinct()
        pieces = [F.substring(F.col(name), a + 1, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]
        keys = [F.struct(F.lit(t).alias("t"), F.concat(*(pieces[i] for i in chosen)).alias("front")) for t, chosen in enumerate(combinations(range(blocks), keep))]
        rows = seen.select(name, F.explode(F.array(*keys)).alias("k"))
        return rows.select(name, F.col("k.t").alias("table"), F.col("k.front").alias("front"))

    met = tables(queries, "query").join(tables(prints, "fingerprint"), ["table", "front"])
    met = met.select("query", "fingerprint", distance(F.col("query"), F.col("fingerprint")).cast("int").alias("distance"))
    return met.filter(F.col("distance") <= radius).distinct()


def _text_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def successors(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The order of the documents: (doc_id, own, n_chars, next_id, next_own, last_id, last_own, last_chars), one row for each id and text.

    The next document has the next larger id; null comes first, equal ids are ordered by a hash of the text, and behind the
    last follows the first. Rows of the same id and text are one document. ``last`` is the one before. A table of the shared folder;
    ids, not texts, are sorted.
    """
    scratch = Scratch(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), _text_key(whole).alias("own"), F.length(whole).cast("long").alias("n_chars"))
    spread = rows.distinct().repartitionByRange("doc_id", "own").withColumn("block", F.spark_partition_id())
    # a table: the blocks must not be cut otherwise by a second run
    spread = scratch.put(spread, "ids")
    this = F.struct("doc_id", "own", "n_chars")
    inside = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "own")
    near = spread.select("block", "doc_id", "own", "n_chars", F.lead(this).over(inside).alias("next"), F.lag(this).over(inside).alias("last"))
    # one row for each block: as many as there are partitions
    ends = spread.groupBy("block").agg(F.min(this).alias("first"), F.max(this).alias("final"))
    line, whole_line = Window.orderBy("block"), Window.partitionBy()
    ends = ends.select(
        "block",
        F.coalesce(F.lead("first").over(line), F.min("first").over(whole_line)).alias("after"),
        F.coalesce(F.lag("final").over(line), F.max("final").over(whole_line)).alias("before"),
    )
    joined = near.join(F.broadcast(ends), "block")
    after, before = F.coalesce("next", "after"), F.coalesce("last", "before")
    joined = joined.select("doc_id", "own", "n_chars", after.alias("next"), before.alias("last"))
    out = joined.select(
        "doc_id",
        "own",
        "n_chars",
        F.col("next.doc_id").alias("next_id"),
        F.col("next.own").alias("next_own"),
        F.col("last.doc_id").alias("last_id"),
        F.col("last.own").alias("last_own"),
        F.col("last.n_chars").alias("last_chars"),
    )
    out = scratch.put(out, "successors")
    scratch.clear(out)
    return out


def _place(key: str, own: str) -> Column:
    """One column to join by, which a null id does not make null."""
    return F.concat_ws(" ", F.coalesce(F.col(key).cast("string"), F.lit("~")), F.col(own))


def edited(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Every text with its end replaced by the beginning of the next document, and the order that this follows.

    The first table: (place, text, edited), one row for each id and text, ``place`` standing for both. The last
    floor(n_chars / 4) code points go, and the first as many of the next document come, or all it has.
    """
    order = successors(docs, text, key)
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).alias("doc_id"), whole.alias("text"), _text_key(whole).alias("own"))
    texts = texts.select(_place("doc_id", "own").alias("place"), "text").dropDuplicates(["place"])
    given = order.select(_place("doc_id", "own").alias("place"), _place("last_id", "last_own").alias("to"), F.floor(F.col("last_chars") / 4).cast("int").alias("n"))
    pieces = texts.join(given, "place").select(F.col("to").alias("place"), F.expr("substring(text, 1, n)").alias("piece"))
    head = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) AS INT))")
    return texts.join(pieces, "place").select("place", "text", F.concat(head, F.col("piece")).alias("edited")), order


def compare_edited(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each of ``docs``.

    near_edited is the likeness of a text to its edited text, near_next that to the next document.
    """
    scratch = Scratch(docs.sparkSession)
    changed, order = edited(docs, text, key)
    both = changed.select("place", _text_key(F.col("edited")).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("which", "text"))
    prints = _vote(both, "text", ["place", "which", "edited_sha256"])
    own, other = (F.max(F.when(F.col("which") == i, F.col("fingerprint"))) for i in (0, 1))
    prints = scratch.put(prints.groupBy("place", "edited_sha256").agg(own.alias("fingerprint"), other.alias("edited_fingerprint")), "prints")
    rows = order.select(_place("doc_id", "own").alias("place"), _place("next_id", "next_own").alias("next"), "n_chars").join(prints, "place")
    after = prints.select(F.col("place").alias("next"), F.col("fingerprint").alias("next_fingerprint"))
    rows = rows.join(after, "next").select(
        "place",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
    # a table: rows that share id and text are split by Spark where one document is very common
    rows = scratch.put(rows, "compared")
    scratch.clear(rows)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows_of = docs.select(F.col(key).alias("doc_id"), _text_key(whole).alias("own")).select(F.col("doc_id").alias(key), _place("doc_id", "own").alias("place"))
    return rows_of.join(rows, "place").drop("place")
