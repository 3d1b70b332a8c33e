"""Ranks and exact quantiles over all rows without a task that holds them all.

Values are counted first. The counts are dealt by value to BUCKETS ranges with approximate quantiles for bounds, summed up
within each range, and set off by the sums of the ranges before. Where the bounds lie changes only how even tasks are,
but a plan makes them more than once, so they hang on the values alone and not on the order in which rows come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 64
#: Values of a group that bounds are taken from, at most: of each class of hashes the one with the least.
SAMPLED = 4096


def bounds(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, _bounds): approximate quantiles of the values, the same ones for the same values however rows are dealt and ordered."""
    h = F.xxhash64(value)
    least = counts.groupBy(*by, F.pmod(h, F.lit(SAMPLED)).alias("_class")).agg(F.min_by(value, h).alias("_least"))
    inner = F.transform(F.sequence(F.lit(1), F.lit(BUCKETS - 1)), lambda i: F.get("_sample", F.floor(i * F.size("_sample") / BUCKETS).cast("int")))
    return least.groupBy(*by).agg(F.array_sort(F.collect_list("_least")).alias("_sample")).select(*by, inner.alias("_bounds"))


def with_before(counts: DataFrame, value: str, weights: list[str], by: list[str]) -> DataFrame:
    """counts (by, value, weights; each value of a group once) with {weight}_before: the sum over smaller values of the group."""
    found = F.broadcast(bounds(counts, value, by))
    dealt = counts.join(found, by) if by else counts.crossJoin(found)
    dealt = dealt.withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "_bucket").agg(*(F.sum(w).alias(f"_{w}") for w in weights))
    sums = sums.select(*by, "_bucket", *(F.coalesce(F.sum(f"_{w}").over(earlier), F.lit(0)).alias(f"_{w}") for w in weights))
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumns({f"{w}_before": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})
    out = dealt.join(F.broadcast(sums), [*by, "_bucket"])
    return out.withColumns({f"{w}_before": F.col(f"{w}_before") + F.col(f"_{w}") for w in weights}).drop("_bucket", *(f"_{w}" for w in weights))


def average_ranks(df: DataFrame, value: str, name: str, by: list[str]) -> DataFrame:
    """(by, value, name): the rank, from 1, of each value of a group, ties at their mean."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return with_before(counts, value, ["_n"], by).select(*by, value, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name))


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, q0, q1, ...): exact quantiles of a column without nulls, linear between the two values beside the place."""
    counts = with_before(df.groupBy(*by, value).agg(F.count("*").alias("_n")), value, ["_n"], by)
    total = F.broadcast(df.groupBy(*by).agg(F.count("*").alias("_all")))
    counts = counts.join(total, by) if by else counts.crossJoin(total)

    def at(place):  # the value with this many before it
        return F.max(F.when((F.col("_n_before") <= place) & (place < F.col("_n_before") + F.col("_n")), F.col(value)))

    places = [(F.col("_all") - 1) * F.lit(q) for q in shares]
    found = counts.groupBy(*by).agg(*(x for i, p in enumerate(places) for x in (at(F.floor(p)).alias(f"_a{i}"), at(F.ceil(p)).alias(f"_b{i}"), F.max(p - F.floor(p)).alias(f"_f{i}"))))
    return found.select(*by, *((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(f"q{i}") for i in range(len(shares))))
