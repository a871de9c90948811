"""URL filters: prefix rules, and a blocked Bloom filter in front of an exact list.

The filter is a small table: one row for each block of 256 bits, as four 64-bit
words. A URL's hash names its block and eight bits there, two in each word, so a
test reads one row. The table has at most ``max_blocks`` rows, whatever the list's
size, which bounds the broadcast; a fuller filter only passes more false hits. What
passes is joined exactly with the list, so no false hit remains.

Null URLs and those without ``://`` have an empty host and path, meet no rule and
are allowed. Repeated rows are judged one by one. An empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.session import materialize

from .common import free_name, lower_ascii

WORDS, BITS = 4, 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.``, then the path without slashes at its end; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", "")))


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (``host/path``) for this host or a domain above it; null if none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is asked first
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")

    def bit(i: int) -> Column:
        # a shift by a column of 0 to 63 places
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", one, place)

    per = BITS // WORDS
    masks = []
    for w in range(WORDS):
        mask = bit(per * w)
        for i in range(1, per):
            mask = mask.bitwiseOR(bit(per * w + i))
        masks.append(mask)
    return masks


def bloom_table(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter over ``column``: (block, w0 ... w3), at most ``blocks`` rows."""
    key = F.col(column)
    words = [m.alias(f"w{i}") for i, m in enumerate(_masks(key))]
    rows = keys.filter(key.isNotNull()).select(_block(key, blocks).alias("block"), *words)
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def blocks_for(n: int, bits_per_key: int = 16, max_blocks: int = 1 << 19) -> int:
    """Blocks of 256 bits for ``n`` keys: a power of two, 16 MB at most by default."""
    need = max(1, n * bits_per_key // 256)
    return min(max_blocks, 1 << (need - 1).bit_length())


def possible_hits(df: DataFrame, column: str, bloom: DataFrame, blocks: int, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: false where ``column`` is certainly not in the filter."""
    key = F.col(column)
    own, block = free_name(df, "__own"), free_name(df, "__block")
    masks = [free_name(df, f"__w{i}") for i in range(WORDS)]
    words = bloom.select(F.col("block").alias(block), *(F.col(f"w{i}").alias(w) for i, w in enumerate(masks)))
    joined = df.withColumn(own, _block(key, blocks))
    # bounded: one row of 40 bytes for each block
    joined = joined.join(F.broadcast(words), F.col(own) == F.col(block), "left")
    hit = key.isNotNull()
    for i, mask in enumerate(_masks(key)):
        hit = hit & (F.col(masks[i]).bitwiseAND(mask) == mask)
    return joined.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(flag))


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: dict[str, str],
    url: str = "url",
    listed_column: str = "canonical",
    max_blocks: int = 1 << 19,
) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict.

    ``listed`` holds canonical URLs (see ``canonical``) to block; ``rules`` maps
    ``host/path`` to allow or block and goes before the list. Columns of ``pages``
    with a name of the result are replaced.
    """
    host, path = host_and_path(F.col(url))
    key, flag, own = (free_name(pages, n) for n in ("__key", "__maybe", "__listed"))
    made = ("host", "path", "rule", "listed", "verdict")
    kept = [c for c in pages.columns if c.lower() not in made]
    base = pages.select(*kept, host.alias("host"), path.alias("path"))
    base = base.withColumns({"rule": matching_rule(F.col("host"), F.col("path"), rules), key: canonical(F.col("host"), F.col("path"))})
    # as a table: read three times, and a plain side of the join, so that Spark can split a hot URL
    keys = materialize(listed.select(F.col(listed_column).alias(own)).filter(F.col(own).isNotNull()).distinct(), "listed")
    blocks = blocks_for(keys.count(), max_blocks=max_blocks)
    tested = possible_hits(base, key, bloom_table(keys, own, blocks), blocks, flag)
    hits = tested.filter(flag).join(keys, F.col(key) == F.col(own), "left")
    out = hits.withColumn("listed", F.col(own).isNotNull()).drop(own)
    out = out.unionByName(tested.filter(~F.col(flag)).withColumn("listed", F.lit(False)))
    verdict = F.lit(None).cast("string")
    for rule, said in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    default = F.when(F.col("listed"), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(verdict, default)).select(*kept, *made)
