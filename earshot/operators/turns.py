"""Raw turns of parsed pages to speaker turns: roles, the start of the questions, statistics and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.functions import text as T
from earshot.sources.pages import TRANSCRIPT_ID, call_columns, with_layout

# Cues of the questions' start, and limits in words.
QNA_CUE = (
    r"(?i)first question|next question|question-and-answer session|question and answer session|q(?:&| and |-and-)a session|poll (?:the audience )?for questions|poll the audience|"
    r"(?:move|turn|go|get) (?:over |on )?(?:to |into )?(?:the )?(?:investor |analyst )?(?:q(?:&| and )a\b|questions)|"
    r"(?:start|begin|open) (?:our |the )?(?:analyst |investor )?(?:q(?:&| and )a\b|questions from)|\[operator instructions\]"
)
SEPARATOR = r"\s+[-–—]+\s+"
FIRST_QUESTION = r"(?i)first question|question-and-answer session|question and answer session"
HANDOFF_WORDS, MONOLOGUE_WORDS, REMARKS_WORDS = 80, 300, 150
UNLISTED, HOST = "Executive (unlisted)", "Investor Relations (unlisted)"


def lookup_roles(turns: DataFrame, participants: DataFrame, call: str = "call") -> DataFrame:
    """turns with listed_role: that of the participant of the same name key (the last listed), else of the only one with the last name.

    participants: call, name, role in list order `pos`. Both sides are aggregated before the joins, so no row multiplies.
    """
    p = participants.withColumn("key", T.name_key(F.col("name"))).groupBy(call, "key").agg(F.max_by("role", "pos").alias("role"))
    last = lambda c: F.element_at(F.split(c, " "), -1)
    by_last = p.withColumn("last", last("key")).groupBy(call, "last").agg(F.count("*").alias("_n"), F.first("role").alias("_only")).filter("_n = 1").drop("_n")
    out = turns.withColumn("key", T.name_key(F.col("speaker"))).withColumn("last", last("key"))
    return out.join(p, [call, "key"], "left").join(by_last, [call, "last"], "left").withColumn("listed_role", F.coalesce("role", "_only")).drop("key", "last", "role", "_only")


def unlisted_management(turns: DataFrame, call: str = "call", words: int = MONOLOGUE_WORDS, cue: str = FIRST_QUESTION) -> DataFrame:
    """turns with role corrected: who is marked Analyst and speaks for `words` words before the first question is management."""
    by_call = Window.partitionBy(call)
    first = F.min(F.when(F.col("text").rlike(cue), F.col("turn"))).over(by_call)
    early = F.coalesce(F.col("turn") < first, F.lit(True))
    long = (F.col("role") == "Analyst") & early & (T.word_count(F.col("text")) >= words)
    marked = turns.withColumn("_long", long)
    who = F.max("_long").over(Window.partitionBy(call, "speaker"))
    return marked.withColumn("role", F.when(who, F.lit(UNLISTED)).otherwise(F.col("role"))).drop("_long")


def split_qna(turns: DataFrame, call: str = "call", cue: str = QNA_CUE, remarks: int = REMARKS_WORDS, handoff: int = HANDOFF_WORDS) -> DataFrame:
    """turns (call, turn, speaker, role, text) with section (prepared, qna) and role (hosts are no analysts).

    The questions start at the first cue after the first long remark: at the first analyst from there on, or one turn
    before if that is a short handoff; without analyst after the cue's turn if that is long; without cue at the first
    analyst. Whoever counts as analyst before that is a host. All are conditional minima over the call's turns.
    """
    w, kind = T.word_count(F.col("text")), T.speaker_type(F.col("speaker"), F.col("role"))
    by_call = Window.partitionBy(call)
    x = turns.withColumns({"_w": w, "_kind": kind})
    x = x.withColumn("_first", F.coalesce(F.min(F.when((F.col("_kind") != "operator") & (F.col("_w") >= remarks), F.col("turn"))).over(by_call), F.lit(0)))
    x = x.withColumn("_cue", F.min(F.when((F.col("turn") > F.col("_first")) & F.col("text").rlike(cue), F.col("turn"))).over(by_call))
    x = x.withColumn("_analyst", F.min(F.when((F.col("_kind") == "analyst") & (F.col("turn") >= F.coalesce("_cue", F.lit(0))), F.col("turn"))).over(by_call))
    words_at = lambda at: F.max(F.when(F.col("turn") == at, F.col("_w"))).over(by_call)
    before, at_cue = words_at(F.col("_analyst") - 1), words_at(F.col("_cue"))
    start = (
        F.when(F.col("_cue").isNull(), F.coalesce("_analyst", F.max("turn").over(by_call) + 1))
        .when(F.col("_analyst").isNotNull(), F.when((F.col("_analyst") > F.col("_cue")) & (before < handoff), F.col("_analyst") - 1).otherwise(F.col("_analyst")))
        .otherwise(F.col("_cue") + (at_cue >= handoff).cast("int"))
    )
    x = x.withColumn("_start", start)
    x = x.withColumn("_key", T.name_key(F.col("speaker")))
    host = F.max((F.col("_kind") == "analyst") & (F.col("turn") < F.col("_start"))).over(Window.partitionBy(call, "_key"))
    x = x.withColumns({"section": F.when(F.col("turn") < F.col("_start"), "prepared").otherwise("qna"), "role": F.when(host, F.lit(HOST)).otherwise(F.col("role"))})
    return x.drop("_w", "_kind", "_first", "_cue", "_analyst", "_start", "_key")


def role_among(people: Column, key: Column) -> Column:
    """The role of the participant of this name key (the last listed), else of the only one with the last name; null if none.

    people: an array of (key, role) in list order, as of one call. What lookup_roles finds by joins.
    """
    last = lambda c: F.element_at(F.split(c, " "), -1)
    same = F.filter(people, lambda p: p["key"] == key)
    family = F.filter(people, lambda p: last(p["key"]) == last(key))
    only = F.when(F.size(F.array_distinct(F.transform(family, lambda p: p["key"]))) == 1, F.try_element_at(family, F.lit(-1))["role"])
    return F.coalesce(F.try_element_at(same, F.lit(-1))["role"], only)


def raw_turns(blocks: DataFrame, call: str = "url") -> DataFrame:
    """Turns of pages.read_blocks: (call, turn, layout, section, speaker, listed_as, text), and in turn -1 `top`, the columns
    of the page's first row, and `people`, the participants listed, in order.

    Headings set the section and the end by running windows over a call's blocks; a paragraph that opens with a strong
    name begins a turn, and what follows up to the next such is its text. Pages with headings have the role beside the
    name; in the others a name ends with a colon, section and role come later, and the text may begin beside the name.
    """
    line, headed = Window.partitionBy(call).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow), F.col("layout") == "legacy"
    own = [c for c in blocks.columns if c not in (call, "pos", "block")]
    x = with_layout(blocks, call).select(call, "pos", "layout", "block.*", F.when(F.col("pos") < 0, F.struct(*own)).alias("_top"))
    h2, p, title = F.col("kind") == "h2", F.col("kind") == "p", F.lower("tight")
    section = F.when(h2 & title.startswith("prepared remarks"), "prepared").when(h2 & title.startswith("questions"), "qna")
    x = x.withColumns({
        "section": F.last(F.when(headed, section), ignorenulls=True).over(line),
        "_over": F.coalesce(F.max(h2 & title.startswith("call participants")).over(line), F.lit(False)),
        "_begun": F.coalesce(F.max(h2 & (F.col("id") == TRANSCRIPT_ID)).over(line), F.lit(False)),
    })
    # the transcript's heading is the first one counted, and the next ends it
    x = x.withColumn("_headings", F.sum(F.when(h2 & F.col("_begun"), 1).otherwise(0)).over(line))
    # of a participant the name is what stands after the last spaced dash, the role what stands before
    parts = F.when(F.col("listed"), F.split("tight", SEPARATOR))
    person = F.struct("pos", T.name_key(F.element_at(parts, -1)).alias("key"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ").alias("role"))
    x = x.withColumn("_person", F.when(F.size(parts) >= 2, person))
    said_here = F.coalesce(p & F.when(headed, F.col("section").isNotNull() & ~F.col("_over")).otherwise(F.col("_headings") == 1), F.lit(False))
    x = x.withColumn("_in", said_here).filter("_in or _top is not null or _person is not null")
    strong, text = F.col("strong"), F.col("text")
    begins = (strong != "") & text.startswith(strong)
    label = F.expr("substring(strong, 1, length(strong) - 1)")
    opens = F.when(headed, begins & ((text == strong) | text.contains(" -- "))).otherwise(begins & strong.endswith(":") & T.looks_like_name(label))
    x = x.withColumn("_opens", F.col("_in") & opens).filter(~F.coalesce(headed & F.col("_opens") & F.lower("strong").startswith("duration"), F.lit(False)))
    counted = (F.sum(F.col("_opens").cast("int")).over(line) - 1).cast("int")
    x = x.withColumn("turn", F.when(F.col("_in"), counted).otherwise(-1))
    said = F.when(~F.col("_opens"), text).when(~headed, F.trim(F.expr("substring(text, length(strong) + 1)")))
    x = x.withColumn("_said", F.when((said != "") & ~T.is_noise(said) & (F.col("turn") >= 0), F.struct("pos", said.alias("s"))))
    role = F.coalesce("em", F.when(F.lower("strong") == "operator", "Operator").otherwise(""))
    first = lambda c: F.max(F.when(F.col("_opens"), c))
    return x.groupBy(call, "turn").agg(
        F.max("layout").alias("layout"), first(F.col("section")).alias("section"), first(F.when(headed, strong).otherwise(F.trim(label))).alias("speaker"), first(F.when(headed, role)).alias("listed_as"),
        F.array_join(F.transform(F.array_sort(F.collect_list("_said")), lambda s: s["s"]), " ").alias("text"),
        F.first("_top", ignorenulls=True).alias("top"), F.array_sort(F.collect_list("_person")).alias("people"),
    )


def speaker_turns(blocks: DataFrame, call: str = "url") -> DataFrame:
    """All turns with text of pages.read_blocks: the page's own columns, call_date, call_time_et, layout and section, speaker, speaker_type, role, text, turn.

    Pages with headings keep their sections, unless all are prepared. Blocks are read once and shuffled once, by call:
    what calls, participants and turns tell each other goes by windows over a call.
    """
    own = [c for c in blocks.columns if c not in (call, "head", "pos", "block", "call_date", "call_time_et")]
    by = Window.partitionBy(call)
    x = raw_turns(blocks, call).withColumn("_key", T.name_key(F.col("speaker")))
    x = x.withColumns({"top": F.first("top", ignorenulls=True).over(by), "people": F.first(F.when(F.col("turn") < 0, F.col("people")), ignorenulls=True).over(by)}).filter("turn >= 0")
    x = x.withColumns(call_columns(F.col("top.head"), F.col("layout"))).filter("error is null").drop("error")
    current = F.col("layout") == "current"
    operator = F.lower("speaker").startswith("operator")
    found = F.coalesce(role_among(F.col("people"), F.col("_key")), F.when(operator, "Operator").otherwise("Analyst"))
    x = x.withColumn("role", F.when(current, found).otherwise(F.col("listed_as"))).select(call, "turn", "layout", "section", "speaker", "role", "text", "call_date", "call_time_et", *(F.col("top")[c].alias(c) for c in own))
    x = unlisted_management(x.withColumn("_role", F.col("role")), call).withColumn("role", F.when(current, F.col("role")).otherwise(F.col("_role")))
    again = current | F.min(F.col("section") == "prepared").over(by)
    x = split_qna(x.withColumns({"_again": again, "_section": F.col("section"), "_role": F.col("role")}), call)
    x = x.withColumns({"section": F.when(F.col("_again"), F.col("section")).otherwise(F.col("_section")), "role": F.when(F.col("_again"), F.col("role")).otherwise(F.col("_role"))})
    return x.drop("_again", "_section", "_role").filter("text <> ''").withColumn("speaker_type", T.speaker_type(F.col("speaker"), F.col("role")))


def parse_stats(records: DataFrame, turns: DataFrame, call: str = "url", min_words: int = 500) -> DataFrame:
    """records (url, ticker, published, call_date, error) with prepared_words, qna_words, both_sections and ok."""
    words = T.word_count(F.col("text"))
    per = turns.filter("speaker_type = 'executive'").groupBy(call).agg(*(F.sum(F.when(F.col("section") == s, words).otherwise(0)).alias(f"{s}_words") for s in ("prepared", "qna")))
    out = records.join(per, call, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("prepared_words", "qna_words")})
    least = F.least("prepared_words", "qna_words")
    ok = (F.coalesce("ticker", F.lit("")) != "") & (F.coalesce("call_date", F.lit("")) != "") & (least >= min_words)
    return out.withColumns({"both_sections": least > 0, "ok": ok & F.col("error").isNull()})


def first_published(stats: DataFrame, by: tuple[str, ...] = ("ticker", "call_date"), order: tuple[str, ...] = ("published", "seq")) -> DataFrame:
    """stats with ok only for the first record of a (ticker, call_date), error "duplicate" for later ones that were ok.

    A first record that isn't ok still keeps later ones out, as the rank is over all records.
    """
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = stats.withColumn("_rn", rn)
    again = F.col("ok") & (F.col("_rn") > 1)
    return ranked.withColumns({"error": F.when(again, F.lit("duplicate")).otherwise(F.col("error")), "ok": F.col("ok") & (F.col("_rn") == 1)}).drop("_rn")


def parse_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("pages"), F.avg(F.col("both_sections").cast("double")).alias("both_share"), F.count_if("ok").alias("calls"), F.countDistinct(F.when(F.col("ok"), F.col("ticker"))).alias("tickers"))


def drop_reasons(stats: DataFrame) -> DataFrame:
    return stats.filter(~F.col("ok")).groupBy(F.coalesce("error", F.lit("short section or no date/ticker")).alias("reason")).agg(F.count("*").alias("n"))
