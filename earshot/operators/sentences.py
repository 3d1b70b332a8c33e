"""Turns to labelled, sampled and split sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import text as T


def to_sentences(turns: DataFrame, min_tokens: int = 6, boilerplate: str = T.BOILERPLATE) -> DataFrame:
    """Management's sentences: (call_id, all columns of turns but text, turn_id, pos, sentence).

    Only executives' turns; sentences below min_tokens tokens or with boilerplate are left out. turn_id is the column
    of that name if turns has it, else a hash of the row, so that samples by it can be repeated; pos counts a turn's sentences from 0. The speaker filter precedes all text work.
    """
    if "turn_id" not in turns.columns:
        turns = turns.withColumn("turn_id", F.xxhash64(*turns.columns))
    said = turns.filter(F.col("speaker_type") == "executive").withColumn("call_id", T.call_id(F.col("ticker"), F.col("call_date")))
    rest = [c for c in said.columns if c not in ("text", "call_id", "turn_id")]
    out = said.select("call_id", *rest, "turn_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))
    return out.filter(T.word_count(F.col("sentence")) >= min_tokens).filter(~T.is_boilerplate(F.col("sentence"), boilerplate))


def with_weak_labels(sentences: DataFrame, lexicon: T.Lexicon = T.Lexicon()) -> DataFrame:
    """Adds certainty, hedging and weak_label (null: mixed)."""
    scored = sentences.withColumns({"certainty": T.certainty(F.col("sentence"), lexicon), "hedging": T.hedging(F.col("sentence"), lexicon)})
    return scored.withColumn("weak_label", T.weak_label(F.col("certainty"), F.col("hedging")))


def label_counts(sentences: DataFrame) -> DataFrame:
    """(label, sentences, calls); null labels count as mixed."""
    return sentences.groupBy(F.coalesce("weak_label", F.lit("mixed")).alias("label")).agg(F.count("*").alias("sentences"), F.countDistinct("call_id").alias("calls"))


def sampling_fractions(sentences: DataFrame, neutral_ratio: float = 1.0, max_sentences: int = 860_000) -> DataFrame:
    """(label, n, frac): all low and high, at most neutral_ratio times their mean of neutral, scaled to max_sentences."""
    n = [F.count_if(F.col("weak_label") == x) for x in T.LABELS]
    one = sentences.agg(*(c.alias(x) for c, x in zip(n, T.LABELS)))
    one = one.withColumn("t_neutral", F.least(F.col("neutral").cast("double"), F.lit(neutral_ratio) * (F.col("low") + F.col("high")) / 2))
    one = one.withColumn("scale", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(float(max_sentences)), F.col("low") + F.col("high") + F.col("t_neutral")), F.lit(1.0))))
    per = [F.struct(F.lit(x).alias("label"), F.col(x).alias("n"), ((F.col("t_neutral") if x == "neutral" else F.col(x)) * F.col("scale") / F.greatest(F.col(x), F.lit(1))).alias("frac")) for x in T.LABELS]
    return one.select(F.inline(F.array(*per)))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from md5 of the key, so that a sample can be repeated and grows with the data."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def stratified_sample(sentences: DataFrame, fractions: DataFrame, key: list[str]) -> DataFrame:
    """Labelled sentences whose uniform number is below their label's fraction; fractions has three rows."""
    return sentences.join(F.broadcast(fractions.select(F.col("label").alias("weak_label"), "frac")), "weak_label").filter(uniform(*[F.col(c).cast("string") for c in key]) < F.col("frac")).drop("frac")


def class_weights(sentences: DataFrame, label: str = "weak_label") -> DataFrame:
    """(label, n, weight): all / (3 * n) for each label, none missing."""
    n = sentences.agg(*(F.count_if(F.col(label) == x).alias(x) for x in T.LABELS))
    total = F.lit(0)
    for x in T.LABELS:
        total = total + F.col(x)
    per = [F.struct(F.lit(x).alias("label"), F.col(x).alias("n"), (total / (F.lit(3.0) * F.greatest(F.col(x), F.lit(1)))).alias("weight")) for x in T.LABELS]
    return n.select(F.inline(F.array(*per)))


def training_sets(sentences: DataFrame, key: list[str] = ["call_id", "turn_id", "pos"], neutral_ratio: float = 1.0, max_sentences: int = 860_000) -> DataFrame:  # noqa: B006
    """Sampled sentences with label (0 to 2) and split (train, val, test by call)."""
    labelled = sentences.filter("weak_label is not null")
    sampled = stratified_sample(labelled, sampling_fractions(labelled, neutral_ratio, max_sentences), key)
    return sampled.withColumns({"label": T.label_index(F.col("weak_label")), "split": T.split_of(F.col("call_id"))})
