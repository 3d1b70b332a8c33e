import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.functions.statistics import incomplete_beta, log_gamma, spearman_p_value, t_p_value
from earshot.operators import linear, scoring, sentences
from earshot.sources import lexicon, tables


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("sentence, label", [
    ("Our plants will always run and we are proud of that.", "high"),
    ("Orders might slip, and it remains to be seen by how much.", "low"),
    ("The board met twice in Lyon in the third quarter.", "neutral"),
    ("Roughly a third of the fleet is approximately new.", "neutral"),
    ("I guess the new site opened in May of last year or so.", "low"),
    ("We feel the mix was what we planned for the period.", None),
    ("We will grow but volumes could fall and might stay so.", "low"),
])
def test_weak_labels(spark, sentence, label):
    assert one(spark, sentence, lambda x: T.weak_label(T.certainty(x), T.hedging(x))) == label


def test_scores_add_up(spark):
    s = "No doubt, no doubt: we must win, and we will. We think perhaps; it depends, should it?"
    assert one(spark, s, lambda x: T.certainty(x)) == 3.5  # no doubt twice, must, half of will
    assert one(spark, s, lambda x: T.hedging(x)) == 6.0  # perhaps, depends, it depends, half of should and of we think, and doubt twice


def test_masking(spark):
    got = one(spark, "Perhaps it is hard to say; the maybelle is firmly moored, or might be. Mustard.", lambda x: T.mask_cues(x, "<c>"))
    assert got == "<c> it is <c>; the maybelle is <c> moored, or <c> be. Mustard."
    assert one(spark, "7 $2 \\1 could", lambda x: T.mask_cues(x, "\\1$0")) == "7 $2 \\1 \\1$0"


@pytest.mark.parametrize("token", ["[MASK]", "e", " a ", "the"])
def test_masking_phrase_after_phrase(spark, token):
    """A pattern for several phrases gives what one phrase after another does, also where they overlap."""
    import re

    rng = random.Random(22)
    phrases = ("ab", "abc", "bca", "ca", "cab b", "b a", "aa", "the a", "e ab")
    lex = T.Lexicon(strong=(), moderate=(), weak=(), uncertainty=(), certainty_phrases=phrases, hedge_phrases=(), soft_phrases=())
    texts = ["".join(rng.choice(["a", "b", "c", " ", "the", "A"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]

    def slow(t):
        for p in sorted(phrases, key=len, reverse=True):
            t = re.sub(re.escape(p), token, t, flags=re.I)
        return t

    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.mask_cues(F.col("x"), token, lex).alias("m")).collect()
    assert all(r["m"] == slow(r["x"]) for r in got)


def slow_sentences(text: str) -> list[str]:
    import re

    text, out, at = re.sub(r"\[[^\]]*\]", " ", text), [], 0
    for i in range(1, len(text)):
        if text[i].isspace() and text[i - 1] in ".!?":
            j = i
            while j < len(text) and text[j].isspace():
                j += 1
            if j < len(text) and (text[j] in "\"'([$" or text[j].isascii() and (text[j].isupper() or text[j].isdigit())):
                out.append(text[at:i])
                at = j
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


def test_sentences_by_search(spark):
    rng = random.Random(21)
    texts = ["".join(rng.choice(["a", "B", ". ", "! ", "?  ", ".", " ", "(", "[x. Y] ", "\n", "4", "$", "é", "É", '"', "'"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.split_sentences(F.col("x")).alias("s")).collect()
    assert all(r["s"] == slow_sentences(r["x"]) for r in got)
    assert one(spark, None, T.split_sentences) is None


def test_names(spark):
    assert one(spark, "Runa K. van Dahl-Moe", T.name_key) == one(spark, "RUNA DahlMoe", T.name_key) == "runa dahlmoe"
    assert one(spark, "\u00c5se 7", T.name_key) == "se" and one(spark, "4.5", T.name_key) == ""
    ok = ["Odd Lie", "a b c d e f g", "x.y z", "Who?", "\u00a0Mads\u00a0Berg"]
    bad = ["", "\n", "\t \n", "\u00a0", "Gate 4", "So! Then", "Yes.\nNo", "a b c d e f g h"]
    assert [one(spark, x, T.looks_like_name) for x in ok + bad] == [True] * len(ok) + [False] * len(bad)
    assert one(spark, "operator 2", lambda x: T.speaker_type(x, F.lit("Lead analyst"))) == "operator" and one(spark, "The operator", lambda x: T.speaker_type(x, F.lit("Lead ANALYST"))) == "analyst"


def test_normalize(spark):
    assert one(spark, "\ufb01ne\u00a0 print\n it ", T.normalize_text) == "fine print it"


@pytest.mark.parametrize("key", ["AAPL_2024-01-01", "", "x", "ümlaut"])
def test_hash_split(spark, key):
    p = int(hashlib.md5(key.encode()).hexdigest(), 16) % 100
    assert one(spark, key, T.hash_percent) == p
    assert one(spark, key, T.split_of) == ("train" if p < 70 else "val" if p < 85 else "test")


def test_management_sentences(spark):
    rows = [
        ("KST", "2020-11-11", "executive", "Thank you all for your time this early day. The shaft at Brenna reached its full depth. It paid."),
        ("KST", "2020-11-11", "analyst", "What would you say of the second shaft by then?"),
        ("KST", "2020-11-11", "operator", "We are ready for all of your lines to open."),
    ]
    got = sentences.to_sentences(spark.createDataFrame(rows, "ticker string, call_date string, speaker_type string, text string")).collect()
    assert [(r["call_id"], r["pos"], r["sentence"]) for r in got] == [("KST_2020-11-11", 1, "The shaft at Brenna reached its full depth.")]


def test_sampling_and_weights(spark):
    df = spark.createDataFrame([("low", i) for i in range(100)] + [("high", i) for i in range(300)] + [("neutral", i) for i in range(2000)] + [(None, 1)], "weak_label string, i int")
    frac = {r["label"]: r["frac"] for r in sentences.sampling_fractions(df, 1.0, 300).collect()}
    assert frac == pytest.approx({"low": 0.5, "high": 0.5, "neutral": 0.05})
    n = {r["weak_label"]: r["count"] for r in sentences.stratified_sample(df, sentences.sampling_fractions(df, 1.0, 300), ["weak_label", "i"]).groupBy("weak_label").count().collect()}
    assert set(n) == {"low", "high", "neutral"} and 100 < n["high"] < 200 and 60 < n["neutral"] < 150
    w = {r["label"]: r["weight"] for r in sentences.class_weights(df).collect()}
    assert w == pytest.approx({"low": 8.0, "high": 2400 / 900, "neutral": 0.4})


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Word,Negative,Uncertainty,Modal\nWILL,0,0,1\nSHOULD,0,0,2\nMAY,0,2009,3\nNEARLY,0,2009,3\nRISK,0,2009,0\nROUGHLY,0,2009,0\nHOUSE,0,0,0\n")
    lex = lexicon.load_lexicon(lexicon.read_dictionary(spark, str(tmp_path / "d.csv")))
    assert (lex.strong, lex.moderate, lex.weak, lex.uncertainty) == (("will",), ("should",), ("may",), ("risk",))
    assert lex.cue_words() == ("may", "risk", "should", "will")


def test_p_values(spark):
    def at(column, *values):
        schema = ", ".join(f"{n} double" for n in "abx"[: len(values[0])])
        return [r[0] for r in spark.createDataFrame(values, schema).select(column(*(F.col(n) for n in "abx"[: len(values[0])]))).collect()]

    ts = (0.0, 0.3, -1.7, 2.0, 40.0)
    for df, want in ((1, lambda t: 1 - 2 / math.pi * math.atan(abs(t))), (2, lambda t: 1 - abs(t) / math.sqrt(2 + t * t)), (4, lambda t: 1 - (u := abs(t) / math.sqrt(4 + t * t)) * (3 - u * u) / 2)):
        assert at(lambda t, n: t_p_value(t, n), *((t, float(df)) for t in ts)) == pytest.approx([want(t) for t in ts], abs=1e-10)  # closed forms
    normal = [math.erfc(t / math.sqrt(2)) for t in (0.1, 1.0, 2.5, 6.0)]  # that of many degrees of freedom
    assert at(t_p_value, *((t, 1e9) for t in (0.1, 1.0, 2.5, 6.0))) == pytest.approx(normal, rel=1e-5)
    assert at(t_p_value, (1.0, 0.0), (None, 4.0)) == [None, None]
    powers = [(a, 1.0, x) for a in (1.0, 2.5, 9.0, 400.0) for x in (0.0, 0.1, 0.9, 1.0)]
    assert at(incomplete_beta, *powers) == pytest.approx([x**a for a, _, x in powers], abs=1e-12)
    both = [(3.5, 0.7, x) for x in (0.01, 0.5, 0.99)]
    assert at(incomplete_beta, *both) == pytest.approx([1 - v for v in at(incomplete_beta, *((b, a, 1 - x) for a, b, x in both))], abs=1e-12)
    assert at(log_gamma, *((x,) for x in (0.5, 1.0, 3.25, 200.0, 1e6))) == pytest.approx([math.lgamma(x) for x in (0.5, 1.0, 3.25, 200.0, 1e6)], rel=1e-13, abs=1e-13)
    r = 0.3
    assert at(spearman_p_value, (-1.0, 9.0), (r, 30.0), (r, 2.0)) == [0.0, pytest.approx(at(t_p_value, (r * math.sqrt(28 / (1 - r * r)), 28.0))[0]), None]


def test_metrics(spark):
    rows = [("low", "low", 0.1), ("low", "high", 0.9), ("high", "high", 0.9), ("high", "high", 0.95), ("neutral", "low", 0.2)]
    df = spark.createDataFrame(rows, "weak_label string, pred string, s double")
    m = scoring.overall(scoring.confusion(df)).first()
    assert (m["n"], m["accuracy"], m["majority_baseline"]) == (5, 0.6, 0.4) and m["macro_f1"] == pytest.approx((0.5 + 0.8 + 0) / 3)
    auc = scoring.roc_auc(df.filter("weak_label <> 'neutral'"), "s", F.col("weak_label") == "high").first()
    assert (auc["n"], auc["auc"]) == (4, pytest.approx(0.875))


def test_scorers(spark):
    good, bad, plain = "we will definitely deliver confident growth", "it may be unclear and risk could hurt", "revenue was ten dollars in total"
    rows = [(f"{s} {w}", label, i) for s, label, i in ((good, "high", 2), (bad, "low", 0), (plain, "neutral", 1)) for w in ("now", "today", "again", "here", "there", "then")]
    df = spark.createDataFrame(rows, "sentence string, weak_label string, label int")
    for scorer in (scoring.lexicon_scorer(), linear.fit(df, 1 << 10)):
        got = scoring.with_confidence(scorer(df))
        assert scoring.overall(scoring.confusion(got)).first()["accuracy"] == 1
        assert got.filter("abs(p_low + p_neutral + p_high - 1) > 1e-9").count() == 0
    check = scoring.context_check(df, scoring.lexicon_scorer()).first()
    assert check["n"] == 12 and check["neutral_share"] == 1 and check["auc"] == 0.5


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("NA", 0.12345), ("B", None)], "ticker string, confidence double")
    tables.write_csv(df, f"{tmp_path}/c", digits=4, gzip=True)
    back = spark.read.option("header", True).schema("ticker string, confidence double").csv(f"{tmp_path}/c")
    assert {(r[0], r[1]) for r in back.collect()} == {("NA", 0.1234), ("B", None)} or {(r[0], r[1]) for r in back.collect()} == {("NA", 0.1235), ("B", None)}
    parts = spark.createDataFrame([(f"c{i % 20}", i) for i in range(400)], "call_id string, i int")
    many = parts.unionByName(spark.range(900).selectExpr("'hot' AS call_id", "cast(id AS int) AS i")).unionByName(spark.createDataFrame([(None, 1)], "call_id string, i int"))
    tables.write_by_call(many, f"{tmp_path}/p", rows=100)
    back = spark.read.parquet(f"{tmp_path}/p").select("call_id", "part", F.input_file_name().alias("f"))
    sizes = {r["part"]: (r["n"], r["calls"], r["files"]) for r in back.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("call_id", F.lit(""))).alias("calls"), F.countDistinct("f").alias("files")).collect()}
    assert back.count() == 1301 and back.select("call_id", "f").distinct().count() == 22
    assert sorted(sizes.values())[-1] == (900, 1, 1) and all(80 < n < 120 and files == 1 for n, calls, files in sizes.values() if calls > 1 and n > 1) and len(sizes) == 5
    tables.write_splits(parts.withColumn("split", T.split_of(F.col("call_id"))), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 400


def test_noise_is_judged_on_every_line(spark, tmp_path):
    from earshot.plans import catalog

    texts = ["Good morning.\n[Music]\nThank you.", "Good morning.\nDuration: 60 minutes", "[Operator Instructions]\nHi.", "We [the firm] grew.\nFine.", "", None]
    spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["noise"] for r in catalog.QUERIES["noise_and_space"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: None}
