"""URL filters: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

A URL's canonical keys are each suffix of its host as a site (`example.com/`), and its host and path. The list is hashed
into blocks of 512 bits, one bit in each of 8 words. The filter has a fixed number of blocks at most, so that it can be
broadcast whatever the list's size; keys that pass it are joined to the list itself, which takes false positives out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: Blocks of 64 bytes: 16 MB at most.
MAX_BLOCKS = 1 << 18
#: Bits for each listed key, as far as MAX_BLOCKS allows.
BITS_PER_KEY = 16
#: Host names are no longer than this.
HOST_CHARS = 253
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, lower-cased; path: from there up to ? or #. Both empty without ://, or for null."""
    url = F.coalesce(url, F.lit(""))
    at = "://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, at, 1), UPPER, LOWER), F.regexp_extract(url, at, 2)


def canonical_keys(host: Column, path: Column) -> Column:
    """Keys by which a URL may be listed. Only suffixes that can be host names are made, so very long hosts stay cheap."""
    labels = F.split(F.right(host, F.lit(HOST_CHARS + 1)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    own = F.concat(host, path)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, F.array(own))))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The bit of each word."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_filter(listed: DataFrame, key_col: str = "key") -> tuple[DataFrame, int]:
    """(block, w0 ... w7) and the number of blocks."""
    blocks = min(MAX_BLOCKS, max(1, -(-listed.count() * BITS_PER_KEY // (64 * WORDS))))
    keyed = listed.select(_block(F.col(key_col), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key_col)))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def listed_urls(urls: DataFrame, listed: DataFrame, key_col: str = "key") -> DataFrame:
    """The distinct urls (column url) of which a canonical key is in the list."""
    listed = listed.where(F.col(key_col).isNotNull()).select(F.col(key_col).alias("key"))
    filter_, blocks = bloom_filter(listed)
    host, path = host_and_path(F.col("url"))
    keys = urls.select("url", F.explode(canonical_keys(host, path)).alias("key")).withColumn("block", _block(F.col("key"), blocks))
    passed = keys.join(F.broadcast(filter_), "block")
    for i, b in enumerate(_bits(F.col("key"))):
        passed = passed.where(F.col(f"w{i}").bitwiseAND(b) != 0)
    return passed.select("url", "key").distinct().join(listed.distinct(), "key", "left_semi").select("url").distinct()


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", key_col: str = "key") -> DataFrame:
    """Each row of pages with host, path, rule and verdict.

    rules: (verdict, host, path), of which the longest that fits decides; it fits its host and all subdomains, if the
    URL's path starts with its own. Without one, rule is null, and a URL that is listed is blocked, others are allowed. A
    null URL, or one without ://, has an empty host and path, fits no rule and is allowed. Rows that repeat are judged
    alike; other columns are ignored, whatever their names. Of a host only the suffixes of up to HOST_CHARS characters are
    looked up, as no host name in DNS is longer. The rules are a short list of parameters, and become expressions. An
    empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    hits = listed_urls(src.select("url"), listed, key_col).withColumn("hit", F.lit(True))
    out = src.join(hits, "url", "left").withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("hit"), "block").otherwise("allow")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, the longer, come first in the expression
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))
