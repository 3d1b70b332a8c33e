"""URL filter: a blocked Bloom filter of listed URLs, then an exact hash join. Built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import BROADCAST_ROWS, SALTS, small_join, unused

#: A block holds WORDS words of 64 bits and a key sets one bit in each. The filter has at most MAX_BLOCKS blocks
#: (about 10 MB), which is the bound of what is broadcast; a longer list raises false positives, which the join removes.
WORDS, BITS_PER_KEY, MAX_BLOCKS = 4, 16, 1 << 18
#: Shapes of rules (host labels, path length) up to which a URL is looked up by each of them.
MAX_SHAPES = 64


def canonical_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased A-Z, up to the first / ? # after ://) and path (up to ? or #); both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_blocks(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """The filter as rows (block, w0..w3) and its number of blocks, at most MAX_BLOCKS."""
    n = 1
    while n < MAX_BLOCKS and n * 64 * WORDS < n_keys * BITS_PER_KEY:
        n *= 2
    marked = keys.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))), n


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict of each row; a column of one of these names is replaced.

    rules: host string, path string (begins with /), verdict string. A rule fits a URL of its host or of a subdomain
    whose path begins with the rule's; of several the longest (host and path together) wins, then the longer host.
    rule is null and the verdict `default` where none fits: null and empty URLs, those without ://, or an empty list.
    Repeated rules count once (the smallest verdict); rules with a null are left out.

    Only the parts of a URL as long as some rule's are looked up: each distinct (number of host labels, path length) of
    the list. If these are over MAX_SHAPES, the rules' paths are looked up by their beginnings of 1, 2, 4, 8, ... characters,
    the longest that fits, and compared to the whole path after the join. So the rows that a URL makes are bounded by the
    labels of a host and the logarithm of the longest path, however many rules there are. Distinct (host, path) give the keys, so a host with a third of all rows is
    aggregated on the map side first. Keys that pass the Bloom filter are joined to the rules exactly; the rules are
    broadcast if there are at most BROADCAST_ROWS of them, and else salted and shuffled.
    """
    urls = urls.drop("host", "path", "rule", "verdict")
    host, path = canonical_parts(F.col(url_col))
    page = urls.withColumns({"host": host, "path": path})
    rules = (
        rules.select(F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("verdict"))
        .dropna()
        .groupBy("rh", "rp")
        .agg(F.min("verdict").alias("verdict"))
        .withColumn("rule", F.concat("rh", "rp"))
    )
    n_labels, shape = F.size(F.split("rh", r"\.")), lambda chars: rules.select(n_labels.alias("labels"), chars.alias("chars")).distinct()
    chars = F.length("rp")
    if len(shape(chars).limit(MAX_SHAPES + 1).collect()) > MAX_SHAPES:
        chars = F.when(chars == 0, F.lit(0)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(chars, F.lit(1)).cast("double")) + 1e-9))).cast("int")
    shapes = shape(chars).collect()
    rules = rules.withColumn("key", F.concat("rh", F.substr("rp", F.lit(1), chars)))
    if not shapes:
        return page.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    n_rules = rules.count()
    blocks, n_blocks = bloom_blocks(rules.select("key").distinct(), "key", n_rules)

    labels = F.split("host", r"\.")
    prefixes = [
        F.when((F.size(labels) >= s["labels"]) & (F.length("path") >= s["chars"]), F.concat(F.array_join(F.slice(labels, -s["labels"], s["labels"]), "."), F.substring("path", 1, s["chars"])))
        for s in sorted(map(lambda r: r.asDict(), shapes), key=lambda s: (s["labels"], s["chars"]))
    ]
    seen = page.filter(F.col("host") != "").select("host", "path").distinct()
    keys = seen.select("host", "path", F.explode(F.array_compact(F.array(*prefixes))).alias("key")).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))
    possible = keys.join(F.broadcast(blocks), "block")
    for i, mask in enumerate(_masks(F.col("key"))):
        possible = possible.filter(F.col(f"w{i}").bitwiseAND(mask) == mask)
    exact = small_join(possible.select("host", "path", "key"), rules, ["key"], "inner", n_rules)
    exact = exact.filter(F.startswith("path", "rp") & ((F.col("host") == F.col("rh")) | F.endswith("host", F.concat(F.lit("."), "rh"))))
    best = exact.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", F.col("verdict").alias("v")), F.struct(F.length("rule"), F.length("rh"), F.col("rule"))).alias("best")
    )
    # A URL path may be that of many rows; rows without a host match nothing and are spread by another hash.
    salt, won = unused(page, "salt", "won")
    spread = page.withColumn(salt, F.when(F.col("host") == "", F.pmod(F.xxhash64(*urls.columns), F.lit(1 << 20)) + SALTS).otherwise(F.pmod(F.xxhash64(*urls.columns), F.lit(SALTS))))
    copies = best.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).withColumnRenamed("best", won)
    return (
        spread.join(copies, ["host", "path", salt], "left")
        .select(*urls.columns, "host", "path", F.col(f"{won}.rule").alias("rule"), F.coalesce(f"{won}.v", F.lit(default)).alias("verdict"))
    )
