"""Exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.llm.common import checkpointed, python_batches
from earshot.llm.tokens import byte_tokenizer

#: Lengths that share a block of the suffix sums.
BLOCK = 1024


def token_lengths(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """n_tokens of each document's whole text and the columns `keep`; null and empty text have 0 tokens."""
    python_batches(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in zip(keep, names)))
    types = dict(slim.dtypes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_tokenizer(vocabulary)
        for b in batches:
            n = [len(bpe.encode_ordinary(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), *b.columns[1:]], ["n_tokens", *names])

    out = slim.mapInArrow(encode, ", ".join(["n_tokens long", *(f"{n} {types[n]}" for n in names)]))
    return out.withColumnsRenamed(dict(zip(names, keep)))


def length_histogram(lengths: DataFrame, by: str | None = None) -> DataFrame:
    """One row for each (group, n_tokens) that occurs: how many documents have this encoded length."""
    group = F.lit(None).cast("string") if by is None else F.col(by).cast("string")
    return lengths.groupBy(group.alias("grp"), "n_tokens").agg(F.count("*").alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """Answers for each context limit that is a length of the group; between two of them they are linear in the limit.

    docs (of just this length), docs_over (longer ones), docs_upto, quantile (docs_upto / all), tokens_upto (of documents
    that fit), tokens_truncated (of all documents cut at the limit), tokens_lost (by the cut) and tokens_total of the
    group. For a limit L between the lengths a < L < b: tokens_truncated(L) = tokens_truncated(a) + (L - a) * docs_over(a).

    Suffix sums go by blocks of BLOCK lengths and then over the blocks' sums, so no task holds more than BLOCK lengths
    of a group or one row for each of a group's blocks. The histogram is checkpointed, as it is read twice and made of
    all texts.
    """
    h = checkpointed(histogram).withColumn("tokens", F.col("docs") * F.col("n_tokens")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    later = Window.partitionBy("grp").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        h.groupBy("grp", "block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
        .select(F.col("grp").alias("g"), F.col("block").alias("b"), F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"), F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"))
    )
    inside = Window.partitionBy("grp", "block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        h.withColumn("d_in", F.coalesce(F.sum("docs").over(inside), F.lit(0))).withColumn("t_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(blocks, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
        .withColumn("docs_over", F.col("d_in") + F.col("d_later"))
        .withColumn("over", F.col("t_in") + F.col("t_later"))
        .select(
            "grp", F.col("n_tokens").alias("context_limit"), "docs", "docs_over", (F.col("d_all") - F.col("docs_over")).alias("docs_upto"),
            ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("quantile"), (F.col("t_all") - F.col("over")).alias("tokens_upto"),
            (F.col("t_all") - F.col("over") + F.col("docs_over") * F.col("n_tokens")).alias("tokens_truncated"),
            (F.col("over") - F.col("docs_over") * F.col("n_tokens")).alias("tokens_lost"), F.col("t_all").alias("tokens_total"),
        )
    )


def at_limit(limits: DataFrame, limit: int) -> DataFrame:
    """tokens_truncated, docs_over and tokens_lost of each group at any limit, from the rows of context_limits."""
    below = F.max_by(F.struct("context_limit", "tokens_truncated", "docs_over"), F.when(F.col("context_limit") <= limit, F.col("context_limit")))
    least = limits.groupBy("grp").agg(below.alias("b"), F.max("tokens_total").alias("tokens_total"), F.sum("docs").alias("all"))
    fits = F.col("b.context_limit") <= limit
    docs_over = F.when(fits, F.col("b.docs_over")).otherwise(F.col("all"))
    cut = F.when(fits, F.col("b.tokens_truncated") + (F.lit(limit) - F.col("b.context_limit")) * docs_over).otherwise(F.lit(limit) * docs_over)
    return least.select("grp", cut.alias("tokens_truncated"), docs_over.alias("docs_over"), (F.col("tokens_total") - cut).alias("tokens_lost"))
