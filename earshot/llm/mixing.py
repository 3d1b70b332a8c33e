"""Mixing sources to target weights by Pareto order sampling. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from earshot.llm.common import checkpointed, hash_uniform, small_join, unused

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more often.
MOST = 3
#: Rows of a source's rank bucket that are ordered together, about.
BUCKET_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """totals (skey, source, source_size) with weight and target of each source.

    All targets add up to all sizes. A target is weight * level, or most * source_size where that is less; the level
    is the one at which the sum is right. That is the share by weight with every excess reshared by weight until no
    target is above its bound. The sources are in one window, as their weights depend on their order: one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("n", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("bound", (F.col("source_size") * most).cast("double"))
    full = Window.orderBy(F.col("bound") / F.col("weight"), "n")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The sources that reach their bound are the first ones by bound / weight. level: if just those before this one did.
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        ranked.withColumn("level", level)
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("bound"))
        .withColumn("at", F.min(F.when(F.col("free"), F.struct(F.col("bound") / F.col("weight"), F.col("n"), F.col("level").alias("level")))).over(all_))
        .withColumn("target", F.least("bound", F.coalesce(F.col("weight") * F.col("at.level"), F.col("bound"))))
        .select("skey", "source_size", "weight", "target")
    )


def _cut(ranked: DataFrame, room: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Border (skey, bucket, before) and cut (skey, c.q, c.upto) of the longest run by q whose words fit into `room`.

    No border: everything fits. No cut: nothing of the border's bucket does; before it are `before` words. n: sources.
    """
    by_bucket = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranked.groupBy("skey", "bucket", room).agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(by_bucket))
    border = sums.filter(F.col("upto") > F.col(room)).groupBy("skey").agg(F.min(F.struct("bucket", F.col("upto") - F.col("words"))).alias("b"))
    border = checkpointed(border.select("skey", F.col("b.bucket").alias("bucket"), F.col("b.col2").alias("before")))
    at_border = small_join(ranked, border, ["skey", "bucket"], "inner", n)
    in_order = Window.partitionBy("skey").orderBy("q").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = at_border.withColumn("upto", F.col("before") + F.sum("size").over(in_order)).filter(F.col("upto") <= F.col(room))
    return border, fits.groupBy("skey").agg(F.max(F.struct("q", "upto")).alias("c"))


def _in_rounds(rounds: Column, size: Column, q: Column) -> Column:
    return F.exists(rounds, lambda x: (size > 0) & (size <= x["upper"]) & (q > x["lo"]) & F.coalesce(q <= x["hi"], F.lit(False)))


#: Documents of a source that still fit up to which the rest of its draw is one fold.
FOLD_ROWS = 20_000


def _fold(left: DataFrame) -> DataFrame:
    """(skey, room, hi, words, runs) of the rest of the draw of each source, its documents in one array by q.

    The fold goes along with the room left: what fits is taken; what fitted when the run began but no longer does ends
    the run, and the next begins behind it.
    """
    run = F.struct(F.col("room").cast("double").alias("upper"), F.col("lo").cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    ranks = left.groupBy("skey", "room", "lo", "q", "size").agg(F.sum("size").cast("double").alias("all"))  # equal rows go together
    line = ranks.groupBy("skey").agg(F.any_value("room").cast("double").alias("room"), F.any_value("lo").cast("double").alias("lo"), F.array_sort(F.collect_list(F.struct("q", F.col("size").cast("double").alias("size"), "all"))).alias("line"))
    begin = F.struct(F.col("room").alias("room"), run.alias("run"), F.array().cast("array<struct<upper:double,lo:double,hi:double>>").alias("done"))

    def step(at: Column, x: Column) -> Column:
        now = at["run"]
        taken = F.struct((at["room"] - x["all"]).alias("room"), F.struct(now["upper"].alias("upper"), now["lo"].alias("lo"), x["q"].alias("hi")).alias("run"), at["done"].alias("done"))
        ended = F.struct(at["room"].alias("room"), F.struct(at["room"].alias("upper"), x["q"].alias("lo"), F.lit(None).cast("double").alias("hi")).alias("run"), F.when(now["hi"].isNull(), at["done"]).otherwise(F.array_append(at["done"], now)).alias("done"))
        return F.when(x["all"] <= at["room"], taken).when(x["size"] <= now["upper"], ended).otherwise(at)

    end = F.aggregate("line", begin, step)
    return line.select("skey", "room", end.alias("end")).select("skey", F.when(F.col("end.run.hi").isNull(), F.col("end.done")).otherwise(F.array_append("end.done", F.col("end.run"))).alias("rounds"), (F.col("room") - F.col("end.room")).alias("used"))


def _fill(left: DataFrame, n: int) -> DataFrame:
    """(skey, rounds, used): going on in the order of q past what is larger than the room left, until nothing fits.

    left: skey, size, q, bucket, room. A round is (upper, lo, hi): taken are sizes up to upper with lo < q <= hi. Each
    round takes the longest run that fits, passes over the rank that did not, and goes on with what still fits. Once that
    is at most FOLD_ROWS documents of each source, as after a round or two, one fold does the rest.
    """
    done = None
    left = checkpointed(left.filter("size > 0 and size <= room").withColumn("lo", F.lit(-1.0)))
    while (left.groupBy("skey").count().agg(F.max("count")).first()[0] or 0) > FOLD_ROWS:
        border, cut = _cut(left, "room", n)
        marks = checkpointed(border.select("skey", F.col("bucket").alias("b")).join(cut.select("skey", F.col("c.q").alias("q_cut")), "skey", "left"))
        run = F.col("b").isNull() | (F.col("bucket") < F.col("b")) | ((F.col("bucket") == F.col("b")) & F.coalesce(F.col("q") <= F.col("q_cut"), F.lit(False)))
        judged = small_join(left, marks, ["skey"], "left", n).withColumn("run", run).drop("b", "q_cut")
        ends = judged.groupBy("skey", "room", "lo").agg(F.max(F.when(F.col("run"), F.col("q"))).alias("hi"), F.coalesce(F.sum(F.when(F.col("run"), F.col("size"))), F.lit(0)).alias("words"), F.min(F.when(~F.col("run"), F.col("q"))).alias("passed"))
        ends = checkpointed(ends)
        one = ends.select("skey", F.array(F.struct(F.col("room").cast("double").alias("upper"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))).alias("rounds"), F.col("words").cast("double").alias("used"))
        done = one if done is None else done.unionByName(one)
        going = small_join(judged.filter(~F.col("run")).drop("room", "lo"), ends.select("skey", (F.col("room") - F.col("words")).alias("room"), F.col("passed").alias("lo")), ["skey"], "inner", n)
        left = checkpointed(going.drop("run").filter((F.col("q") > F.col("lo")) & (F.col("size") <= F.col("room"))))
    rest = _fold(left)
    done = rest if done is None else done.unionByName(rest)
    return checkpointed(done.groupBy("skey").agg(F.flatten(F.collect_list("rounds")).alias("rounds"), F.sum("used").alias("used")))


#: Preferences count in steps of one over this number, so that their sums are exact.
STEP = 1024


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, preference: str | None = None, tolerance: float = 0.0) -> DataFrame:
    """docs with size, source_size, target (its source's), copies and taken (size * copies) of each row.

    A source is due target / source_size copies of each document. The whole copies are certain; for the rest, r words,
    documents are ranked by Pareto's q = odds(u) / odds(p): u is a hash of id and text in (0, 1), p the inclusion
    probability r / (words left to draw from). `preference`, SQL for a positive number of docs' columns and `size`, makes
    p unequal within a source: p is multiplied by it over its mean per word, and p of 1 or more is certain (q = 0).
    Documents are taken in the order of q up to the last rank at which the words still fit into r; then the one document
    not taken whose size comes closest to the rest, where it lowers the difference. Where documents left out would still
    fit after that, as behind a very long one, the order of q is followed to its end past all that is larger than the
    room left (`_fill`), then the closest one is added, and this is taken if it is not farther from r. So a source's
    taken words differ from its target by less than its smallest document left out or by less than that way. With a
    tolerance the first cut stands where it misses at most this share of the target and at most the mean size left out.

    Rows of equal id, text and source have one rank. They are taken together if they all fit; as the closest document
    as many of them are taken as fit best, one at least.

    Null text has size 0; a null source is a source, the last; documents of size 0 have taken 0; null ids differ by their
    texts. An empty table gives an empty table. Columns of docs named like a result are replaced. The same rows give the
    same mix.

    No window holds a whole source: sizes are summed by (source, bucket of q), buckets are accumulated, and only the
    bucket at the border is ordered by q. The id, source, size and u of all documents are checkpointed once, so texts
    are read twice.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*made)
    skey, q, q_cut, base, pref, part = unused(docs, "skey", "q", "q_cut", "base", "pref", "part")
    keyed = docs.withColumns({
        "size": size_of(F.col(text_col)),
        skey: F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string"))),
        q: hash_uniform(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))),
        part: F.spark_partition_id(),
    })
    steps = F.lit(STEP) if preference is None else F.greatest(F.coalesce(F.round(F.expr(preference).cast("double") * STEP), F.lit(0.0)), F.lit(0.0))
    keyed = keyed.withColumn(pref, steps.cast("long"))
    slim = checkpointed(keyed.select(F.col(skey).alias("skey"), F.col(source_col).cast("string").alias("source"), "size", F.col(q).alias("u"), F.col(pref).alias("pref")))
    totals = slim.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), (F.sum(F.col("size") * F.col("pref")) / STEP).alias("preferred"), F.count("*").alias("docs"))
    targets = source_targets(totals.select("skey", "source", "source_size"), weights, most).join(totals.select("skey", "preferred", "docs"), "skey")
    due = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    targets = (
        targets.withColumn("base", F.least(F.floor(due + 1e-9), F.lit(most)).cast("long"))
        .withColumn("rest", F.when(F.col("base") >= most, F.lit(0.0)).otherwise(F.greatest(F.col("target") - F.col("base") * F.col("source_size"), F.lit(0.0))))
        .withColumn("per_pref", F.coalesce(F.try_divide("rest", "preferred"), F.lit(0.0)))
        .withColumn("buckets", F.least(F.greatest(F.ceil(F.col("docs") / BUCKET_ROWS), F.lit(16)), F.lit(65_536)))
    )
    targets = checkpointed(targets)
    n = targets.count()

    def pareto(u: Column, pref: Column, per_pref: Column) -> Column:
        p = pref / STEP * per_pref
        return F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(float("inf"))).otherwise(u / (1 - u) * (1 - p) / p)

    def bucket_of(q: Column, buckets: Column) -> Column:
        return F.when(q == float("inf"), buckets).otherwise(F.floor(q / (1 + q) * buckets)).cast("long")

    due_now = small_join(slim, targets.select("skey", "rest", "per_pref", "buckets"), ["skey"], "inner", n)
    ranked = due_now.select("skey", "size", "rest", pareto(F.col("u"), F.col("pref"), F.col("per_pref")).alias("q"), "buckets")
    ranked = ranked.withColumn("bucket", bucket_of(F.col("q"), F.col("buckets")))
    border, cut = _cut(ranked, "rest", n)
    # Taken are all below the border's bucket, and in it those up to q_cut; without a border everything fits.
    cuts = (
        targets.select("skey", "source_size", "target", "base", "rest", "per_pref", "buckets").join(border, "skey", "left").join(cut, "skey", "left")
        .withColumn("q_cut", F.col("c.q"))
        .withColumn("taken_words", F.coalesce(F.col("c.upto"), F.col("before")))
    )
    cuts = checkpointed(cuts.select("skey", "source_size", "target", "base", "rest", "per_pref", "buckets", "bucket", "q_cut", "taken_words"))
    first = (F.col("bucket").isNull()) | (F.col("b") < F.col("bucket")) | ((F.col("b") == F.col("bucket")) & F.coalesce(F.col("q") <= F.col("q_cut"), F.lit(False)))
    left = (
        small_join(ranked.withColumnRenamed("bucket", "b").drop("rest", "buckets"), cuts.select("skey", "rest", "bucket", "q_cut", "taken_words"), ["skey"], "inner", n)
        .filter(F.col("bucket").isNotNull() & ~first & (F.col("size") > 0))
        .select("skey", "size", "q", F.col("b").alias("bucket"), (F.col("rest") - F.col("taken_words")).alias("room"))
    )
    gap, drawn = F.abs(F.col("room") - F.col("size")), F.when(F.col("q") < float("inf"), F.col("size"))
    extra_of = F.min(F.when(gap < F.col("room"), F.struct(gap.alias("gap"), "q", "size"))).alias("extra")
    left_out = left.groupBy("skey").agg(extra_of, F.min(drawn).alias("least"), F.avg(drawn).alias("mean"), F.any_value("room").alias("room"))
    miss = F.abs(F.col("room") - F.coalesce(F.col("extra.size"), F.lit(0)))
    ends = cuts.join(left_out, "skey", "left").withColumn("miss", miss).withColumn("short", F.coalesce((F.col("least") <= F.col("room")) & (miss >= F.col("least")) & ((miss > F.col("target") * tolerance) | (miss > F.col("mean"))), F.lit(False)))
    ends = checkpointed(ends.select("skey", "source_size", "target", "base", "per_pref", "buckets", "bucket", "q_cut", "extra", "room", "miss", "short"))
    short = checkpointed(ends.filter("short").select("skey", "miss"))
    ends = ends.withColumn("rounds", F.lit(None).cast("array<struct<upper:double,lo:double,hi:double>>"))
    if n_short := short.count():
        behind = checkpointed(small_join(left, short.select("skey"), ["skey"], "inner", n_short))
        filled = _fill(behind.filter(F.col("q") < float("inf")), n_short)
        after = small_join(behind, filled, ["skey"], "left", n_short).withColumn("room", F.col("room") - F.coalesce(F.col("used"), F.lit(0)))
        is_left = ~F.coalesce(_in_rounds(F.col("rounds"), F.col("size"), F.col("q")), F.lit(False))
        again = after.groupBy("skey").agg(F.min(F.when(is_left & (gap < F.col("room")), F.struct(gap.alias("gap"), "q", "size"))).alias("extra_after"), F.any_value("room").alias("room_after"))
        nearer = checkpointed(again.join(short, "skey").filter(F.coalesce("extra_after.gap", "room_after") <= F.col("miss")).join(filled.select("skey", F.col("rounds").alias("r")), "skey"))
        by_rounds = F.col("r").isNotNull()
        ends = ends.join(nearer.drop("miss"), "skey", "left").withColumns({"extra": F.when(by_rounds, F.col("extra_after")).otherwise(F.col("extra")), "room": F.when(by_rounds, F.col("room_after")).otherwise(F.col("room")), "rounds": F.col("r")})
    ends = checkpointed(ends.select("skey", "source_size", "target", "base", "per_pref", "buckets", "bucket", "q_cut", F.col("extra.q").alias("extra"), F.col("extra.size").alias("extra_size"), "room", "rounds"))
    # How many rows the closest document stands for, and how many of them are taken.
    twins = small_join(ranked.select("skey", "size", "q"), ends.filter("extra is not null").select("skey", "extra", "extra_size"), ["skey"], "inner", n)
    twins = twins.filter((F.col("q") == F.col("extra")) & (F.col("size") == F.col("extra_size"))).groupBy("skey").agg(F.count("*").alias("rows"))
    of_rows = F.least(F.col("rows"), F.greatest(F.floor(F.col("room") / F.col("extra_size") + 0.5), F.lit(1)))
    ends = checkpointed(ends.join(twins, "skey", "left").withColumn("of_rows", of_rows).drop("room"))
    n_parted = ends.filter("of_rows < rows").count()

    names = dict(zip(ends.columns, unused(docs.select(*docs.columns, *(F.lit(0).alias(x) for x in ("size", skey, q, q_cut, base, pref, part))), *ends.columns)))
    names |= {"skey": skey, "source_size": "source_size", "target": "target"}
    c = {k: F.col(v) for k, v in names.items()}
    out = small_join(keyed, ends.withColumnsRenamed(names), [skey], "left", n).withColumn(q, pareto(F.col(q), F.col(pref), c["per_pref"]))
    b, drawn = bucket_of(F.col(q), c["buckets"]), F.col(q) < float("inf")
    upto = c["bucket"].isNull() | (b < c["bucket"]) | ((b == c["bucket"]) & F.coalesce(F.col(q) <= c["q_cut"], F.lit(False)))
    twin = F.coalesce((F.col(q) == c["extra"]) & (F.col("size") == c["extra_size"]), F.lit(False))
    sampled = drawn & (upto | F.coalesce(_in_rounds(c["rounds"], F.col("size"), F.col(q)), F.lit(False))) | twin

    def taken(rows: DataFrame, sampled: Column) -> DataFrame:
        copies = F.least(c["base"] + sampled.cast("long"), F.lit(most)).cast("long")
        return rows.select(*docs.columns, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast(T.LongType()).alias("taken"))

    if not n_parted:
        return taken(out, sampled)
    # Equal rows of which some are taken: so many of each part of the input, in the order of the parts.
    parted = twin & (c["of_rows"] < c["rows"])
    few = out.filter(parted)
    by_part = checkpointed(few.groupBy(skey, part).agg(F.count("*").alias("here"), F.any_value(c["of_rows"]).alias("all")))
    before = F.coalesce(F.sum("here").over(Window.partitionBy(skey).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    due_here, number = unused(out, "due_here", "number")
    by_part = by_part.select(skey, part, F.greatest(F.least(F.col("here"), F.col("all") - before), F.lit(0)).alias(due_here))
    few = few.withColumn(number, F.row_number().over(Window.partitionBy(skey, part).orderBy(q))).join(by_part, [skey, part])
    return taken(out.filter(~parted), sampled).unionByName(taken(few, F.col(number) <= F.col(due_here)))
