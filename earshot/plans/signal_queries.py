"""Calls, signals, sentences and words as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.functions.phrases import mask_phrases, weighted_count
from earshot.operators import linear, report, scoring, sentences, signals
from earshot.plans import analogues as A

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(*names: str, digits: int = 6):
    return [F.round(F.col(n), digits).alias(n) for n in names]


def calls(spark, d) -> DataFrame:
    return signals.call_features(A.scored_sentences(spark, d))


def made(spark, d) -> DataFrame:
    return signals.make_signals(calls(spark, d))


@query(f"WITH {A.CALLS_SQL} SELECT call_id, ticker, call_date, round(conf_prepared, 6) AS conf_prepared, round(conf_qna, 6) AS conf_qna, round(pct_low_prepared, 6) AS pct_low_prepared, round(pct_low_qna, 6) AS pct_low_qna, round(pct_high_prepared, 6) AS pct_high_prepared, round(pct_high_qna, 6) AS pct_high_qna, n_prepared, n_qna, round(gap, 6) AS gap FROM calls")
def call_features_pivot(spark, d):
    return calls(spark, d).select("call_id", "ticker", "call_date", *r("conf_prepared", "conf_qna", "pct_low_prepared", "pct_low_qna", "pct_high_prepared", "pct_high_qna"), "n_prepared", "n_qna", *r("gap"))


@query(f"WITH {A.CALLS_SQL} SELECT call_id, round(confidence, 6) AS confidence FROM calls")
def weighted_confidence(spark, d):
    return calls(spark, d).withColumn("confidence", signals.weighted_confidence()).select("call_id", *r("confidence"))


@query("""WITH days AS (SELECT o_orderdate::DATE AS d, count(*) AS n, sum(o_totalprice / 1000) AS s, sum((o_totalprice / 1000) ** 2) AS q FROM orders GROUP BY 1),
past AS (SELECT d, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM days WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_orderkey AS call_id, o_orderdate::DATE AS call_date, round(CASE WHEN n >= 20 AND (q - s * s / n) / (n - 1) > 0 THEN (o_totalprice / 1000 - s / n) / sqrt((q - s * s / n) / (n - 1)) END, 6) AS confidence_z
FROM orders LEFT JOIN past ON o_orderdate::DATE = d""")
def expanding_z(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.to_date("o_orderdate").alias("call_date"), (F.col("o_totalprice") / 1000).alias("confidence"))
    return signals.expanding_z(o).select("call_id", "call_date", *r("confidence_z"))


@query(f"WITH {A.SIGNALS_SQL} SELECT call_id, ticker, call_date, signal, round(confidence, 6) AS confidence, round(confidence_z, 6) AS confidence_z, round(gap, 6) AS gap, sentences, warmup FROM signals")
def signals_threshold(spark, d):
    return made(spark, d).select("call_id", "ticker", "call_date", "signal", *r("confidence", "confidence_z", "gap"), "sentences", "warmup")


@query(f"WITH {A.SIGNALS_SQL} SELECT call_id, ticker, round(confidence_change, 6) AS confidence_change FROM signals")
def confidence_change(spark, d):
    return made(spark, d).select("call_id", "ticker", *r("confidence_change"))


@query(f"WITH {A.CALLS_SQL} SELECT call_id, round(conf_qna - lag(conf_qna) OVER (PARTITION BY ticker ORDER BY call_date, call_id), 6) AS delta_qoq FROM calls")
def delta_qoq(spark, d):
    return signals.lag_change(calls(spark, d), "conf_qna", "delta_qoq", order=("call_date", "call_id")).select("call_id", *r("delta_qoq"))


@query(f"""WITH {A.SIGNALS_SQL}, live AS (SELECT * FROM signals WHERE NOT warmup), recent AS (SELECT * FROM live WHERE call_date >= (SELECT max(call_date) FROM live) - INTERVAL 45 DAY AND signal <> 'HOLD')
SELECT ticker, call_date, signal, round(confidence_z, 6) AS confidence_z FROM (
  (SELECT * FROM recent WHERE signal = 'BUY' ORDER BY confidence_z DESC, ticker, call_date LIMIT 15) UNION ALL (SELECT * FROM recent WHERE signal = 'SELL' ORDER BY confidence_z, ticker, call_date LIMIT 15))""")
def latest_signals(spark, d):
    return signals.latest(made(spark, d)).select("ticker", "call_date", "signal", *r("confidence_z"))


@query(f"""WITH {A.SIGNALS_SQL}, g AS (SELECT date_trunc('quarter', call_date)::DATE AS quarter, count(*) AS calls, avg(confidence) AS confidence, avg((signal = 'BUY')::INT) AS buy_share, avg((signal = 'SELL')::INT) AS sell_share FROM signals GROUP BY 1 HAVING count(*) >= 20)
SELECT q::DATE AS quarter, calls, round(confidence, 6) AS confidence, round(buy_share, 6) AS buy_share, round(sell_share, 6) AS sell_share
FROM (SELECT unnest(generate_series((SELECT min(quarter) FROM g), (SELECT max(quarter) FROM g), INTERVAL 3 MONTH)) AS q) LEFT JOIN g ON q::DATE = quarter""")
def quarter_index(spark, d):
    return report.quarter_index(made(spark, d)).select("quarter", "calls", *r("confidence", "buy_share", "sell_share"))


@query(f"""WITH {A.SIGNALS_SQL}, b AS (SELECT signal, least(floor((least(greatest(confidence_z, -4.0), 4.0) + 4.0) / 0.1)::BIGINT + 1, 80) AS bin FROM signals WHERE confidence_z IS NOT NULL)
SELECT signal, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY signal), 6) AS share FROM b GROUP BY 1, 2""")
def z_histogram(spark, d):
    return report.z_histogram(made(spark, d)).select("signal", "bin", "n", *r("share"))


@query(f"""WITH {A.SIGNALS_SQL}, n AS (SELECT ticker, count(*) AS calls, list_position(['C7', 'C3', 'C11', 'C999999'], ticker) AS listed FROM signals GROUP BY 1),
k AS (SELECT ticker, calls, row_number() OVER (ORDER BY coalesce(listed, 1000000), calls DESC, ticker) AS pos FROM n WHERE (listed IS NOT NULL AND calls >= 3) OR (listed IS NULL AND calls >= 6)) SELECT ticker, calls, pos::INT AS pos FROM k WHERE pos <= 9""")
def chart_tickers(spark, d):
    return report.chart_tickers(made(spark, d), ["C7", "C3", "C11", "C999999"])


@query("SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 600")
def scatter_sample(spark, d):
    return report.scatter_sample(A.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 600).withColumn("h", F.md5(F.col("o_orderkey").cast("string")))


@query(f"WITH {A.CALLS_SQL} SELECT count(*) AS calls, round(avg(conf_prepared), 6) AS conf_prepared, round(avg(conf_qna), 6) AS conf_qna, round(avg((gap < 0)::INT), 6) AS gap_below_zero FROM calls")
def score_summary(spark, d):
    return scoring.score_summary(calls(spark, d)).select("calls", *r("conf_prepared", "conf_qna", "gap_below_zero"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, [l_discount, l_tax, 0.05] AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, ['low', 'neutral', 'high'][list_position(v, list_max(v))] AS pred FROM p""")
def argmax_label(spark, d):
    li = A.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", scoring.predicted([F.col("l_discount"), F.col("l_tax"), F.lit(0.05)]).alias("pred"))


# Words and sentences over all documents.
def docs(spark, d) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", "text", "source")


SENT_SQL = r"""sents AS (
  SELECT doc_id, source, pos, sentence FROM (
    SELECT doc_id, source, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM (
      SELECT doc_id, source, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\[[^\]]*\]', ' ', 'g'), '([.!?])\s+([A-Z"''(\[$0-9])', '\1' || chr(31) || '\2', 'g'), chr(31)),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)))"""


def sents(spark, d) -> DataFrame:
    return docs(spark, d).select("doc_id", "source", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"WITH {SENT_SQL} SELECT doc_id, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars, min(md5(sentence)) AS least FROM sents GROUP BY 1")
def sentence_split(spark, d):
    return sents(spark, d).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("sentence")).alias("chars"), F.min(F.md5("sentence")).alias("least"))


@query(f"WITH {SENT_SQL} SELECT doc_id, pos::INT AS pos, md5(sentence) AS sentence_md5 FROM sents WHERE len(regexp_extract_all(sentence, '\\S+')) >= 6 AND NOT regexp_matches(sentence, '{A.BOILERPLATE}', 'i')")
def sentence_filter(spark, d):
    t = docs(spark, d).select(F.col("doc_id").alias("turn_id"), F.lit("T").alias("ticker"), F.lit("D").alias("call_date"), F.lit("executive").alias("speaker_type"), "text")
    return sentences.to_sentences(t, 6, A.BOILERPLATE).select(F.col("turn_id").alias("doc_id"), "pos", F.md5("sentence").alias("sentence_md5"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INT AS tokens FROM documents")
def token_count(spark, d):
    return docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("tokens"))


_L = A.LEXICON
_list = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]"
_phr = lambda x, w=1.0: " + ".join(f"{w} * (length(s) - length(replace(s, '{p}', ''))) / {len(p)}" for p in x)
SCORE_SQL = f"""{SENT_SQL}, tok AS (SELECT *, lower(sentence) AS s, regexp_extract_all(lower(sentence), '[a-z'']+') AS t FROM sents),
scores AS (SELECT *, len(list_filter(t, lambda w: w = 'is')) + 0.5 * len(list_filter(t, lambda w: w IN ('and', 'will'))) + {_phr(_L.certainty_phrases)} AS certainty,
  len(list_filter(t, lambda w: w IN ('of', 'for', 'to', 'that'))) + 0.5 * len(list_filter(t, lambda w: w IN ('with', 'was'))) + {_phr(_L.hedge_phrases)} + {_phr(_L.soft_phrases, 0.5)} AS hedging FROM tok),
labelled AS (SELECT *, CASE WHEN certainty = 0 AND hedging = 0 THEN 'neutral' WHEN certainty - hedging >= 1 THEN 'high' WHEN certainty - hedging <= -1 THEN 'low' END AS weak_label FROM scores)"""


def labelled(spark, d) -> DataFrame:
    return sentences.with_weak_labels(sents(spark, d), _L).withColumn("call_id", F.col("source"))


@query(f"WITH {SCORE_SQL} SELECT doc_id, round(sum(certainty)::DOUBLE, 4) AS certainty, round(sum(hedging)::DOUBLE, 4) AS hedging, round(max(certainty)::DOUBLE, 4) AS most FROM scores GROUP BY 1")
def lexicon_score(spark, d):
    return labelled(spark, d).groupBy("doc_id").agg(F.round(F.sum("certainty"), 4).alias("certainty"), F.round(F.sum("hedging"), 4).alias("hedging"), F.round(F.max("certainty"), 4).alias("most"))


@query(f"WITH {SCORE_SQL} SELECT doc_id, pos::INT AS pos, weak_label FROM labelled")
def weak_label(spark, d):
    return labelled(spark, d).select("doc_id", "pos", "weak_label")


@query(f"WITH {SCORE_SQL} SELECT coalesce(weak_label, 'mixed') AS label, count(*) AS sentences, count(DISTINCT source) AS calls FROM labelled GROUP BY 1")
def label_counts(spark, d):
    return sentences.label_counts(labelled(spark, d))


FRAC_SQL = f"""{SCORE_SQL}, n AS (SELECT count(*) FILTER (weak_label = 'low') AS low, count(*) FILTER (weak_label = 'neutral') AS neutral, count(*) FILTER (weak_label = 'high') AS high FROM labelled),
t AS (SELECT *, least(neutral, (low + high) / 2) AS tn FROM n), sc AS (SELECT *, least(1.0, 5000.0 / (low + high + tn)) AS scale FROM t),
fractions AS (SELECT 'low' AS label, low AS n, low * scale / greatest(low, 1) AS frac FROM sc UNION ALL SELECT 'neutral', neutral, tn * scale / greatest(neutral, 1) FROM sc UNION ALL SELECT 'high', high, high * scale / greatest(high, 1) FROM sc)"""


@query(f"WITH {FRAC_SQL} SELECT label, n, round(frac::DOUBLE, 6) AS frac FROM fractions")
def sampling_fractions(spark, d):
    return sentences.sampling_fractions(labelled(spark, d), 1.0, 5000).select("label", "n", *r("frac"))


@query(f"WITH {FRAC_SQL} SELECT doc_id, pos::INT AS pos, weak_label FROM labelled JOIN fractions ON weak_label = label WHERE ('0x' || substr(md5(doc_id || '|' || pos), 1, 8))::BIGINT / 4294967296.0 < frac")
def stratified_hash_sample(spark, d):
    x = labelled(spark, d).select("doc_id", "pos", "weak_label").cache()  # read for the fractions and for the sample
    return sentences.stratified_sample(x, sentences.sampling_fractions(x, 1.0, 5000), ["doc_id", "pos"]).select("doc_id", "pos", "weak_label")


@query(f"WITH {SCORE_SQL}, n AS (SELECT weak_label AS label, count(*) AS n FROM labelled WHERE weak_label IS NOT NULL GROUP BY 1) SELECT label, n, round(sum(n) OVER () / (3.0 * greatest(n, 1)), 6) AS weight FROM n")
def class_weights(spark, d):
    return sentences.class_weights(labelled(spark, d)).select("label", "n", *r("weight"))


@query(f"""WITH {SENT_SQL}, m AS (SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sentence, 'the th', '[MASK]', 'gi'), 'on the', '[MASK]', 'gi'), 'in the', '[MASK]', 'gi'), 're an', '[MASK]', 'gi'), 'a the', '[MASK]', 'gi'), 'of a', '[MASK]', 'gi') AS s FROM sents)
SELECT doc_id, pos::INT AS pos, md5(array_to_string(list_transform(regexp_extract_all(s, '[A-Za-z'']+|[^A-Za-z'']+'), lambda x: CASE WHEN lower(x) IN ('is', 'will', 'and', 'with', 'was', 'of', 'for', 'to', 'that') THEN '[MASK]' ELSE x END), '')) AS masked_md5 FROM m""")
def mask_cues(spark, d):
    return sents(spark, d).select("doc_id", "pos", F.md5(T.mask_cues(F.col("sentence"), "[MASK]", _L)).alias("masked_md5"))


#: Word pairs of the benchmark that many_phrases counts and masks: the most frequent ones, a list like a dictionary's.
PAIRS = 1000


@query(f"""WITH {SENT_SQL}, w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z'']+') AS t FROM benchmark),
p AS (SELECT pair FROM (SELECT unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) AS pair FROM w) GROUP BY pair ORDER BY count(*) DESC, pair LIMIT {PAIRS}),
g AS (SELECT list(pair ORDER BY length(pair) DESC, pair) AS pairs FROM p)
SELECT doc_id, pos::INT AS pos, list_sum([(length(lower(sentence)) - length(replace(lower(sentence), p, ''))) // length(p) FOR p IN pairs])::DOUBLE AS hits,
  md5(list_reduce(pairs, lambda s, p: replace(s, p, '[#]'), lower(sentence))) AS masked_md5 FROM sents, g""")
def many_phrases(spark, d):
    """A thousand phrases counted and masked in each sentence, in a pass each."""
    words = A.table(spark, d, "benchmark").select(T.words(F.col("text")).alias("w"))
    pairs = words.select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))).alias("pair"))
    chosen = sorted(r["pair"] for r in pairs.groupBy("pair").count().orderBy(F.desc("count"), "pair").limit(PAIRS).collect())
    s = F.lower("sentence")
    dealt = sents(spark, d).repartition("doc_id", "pos")  # a few row groups of documents would keep a few cores busy only
    return dealt.select("doc_id", "pos", weighted_count(s, dict.fromkeys(chosen, 1.0)).alias("hits"), F.md5(mask_phrases(s, chosen, "[#]")).alias("masked_md5"))


@query("""WITH h AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS m FROM orders), f AS (SELECT o_orderkey, (((((('0x' || substr(m, 1, 8))::BIGINT % 100) * 96 + ('0x' || substr(m, 9, 8))::BIGINT) % 100 * 96 + ('0x' || substr(m, 17, 8))::BIGINT) % 100) * 96 + ('0x' || substr(m, 25, 8))::BIGINT) % 100 AS p FROM h)
SELECT o_orderkey AS call_id, CASE WHEN p < 70 THEN 'train' WHEN p < 85 THEN 'val' ELSE 'test' END AS split FROM f""")
def hash_split(spark, d):
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), T.split_of(F.col("o_orderkey").cast("string")).alias("split"))


@query("WITH n AS (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z ]', '', 'g')) AS k FROM customer) SELECT c_custkey, CASE WHEN strpos(k, ' ') > 0 THEN regexp_extract(k, '^[^ ]+') || ' ' || regexp_extract(k, '[^ ]+$') ELSE k END AS name_key FROM n")
def name_key(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", T.name_key(F.col("c_name")).alias("name_key"))


@query(r"""WITH l AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN chr(10) || chr(9) WHEN 2 THEN ' ' WHEN 3 THEN p_name || chr(9) || 'a b' || chr(10) || 'c d e' WHEN 4 THEN 'x. y ' || p_name ELSE p_name || chr(10) || '7' END AS label FROM part)
SELECT p_partkey, len(regexp_extract_all(label, '\S+')) BETWEEN 1 AND 7 AND NOT regexp_matches(label, '\d|[.!?]\s') AS is_name FROM l""")
def looks_like_name(spark, d):
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    label = F.when(k == 0, n).when(k == 1, "\n\t").when(k == 2, " ").when(k == 3, F.concat(n, F.lit("\ta b\nc d e"))).when(k == 4, F.concat(F.lit("x. y "), n)).otherwise(F.concat(n, F.lit("\n7")))
    return A.table(spark, d, "part").select("p_partkey", T.looks_like_name(label).alias("is_name"))


@query("SELECT conv_id, turn, CASE WHEN starts_with(lower(role), 'operator') THEN 'operator' WHEN contains(lower(role), 'user') THEN 'executive' ELSE 'executive' END AS kind, CASE WHEN contains(lower(replace(role, 'user', 'Sell-side Analyst')), 'analyst') THEN 'analyst' ELSE 'executive' END AS speaker_type FROM conversations")
def speaker_type(spark, d):
    c = A.table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.speaker_type(F.col("role"), F.lit("")).alias("kind"), T.speaker_type(F.lit("Pat"), F.replace("role", F.lit("user"), F.lit("Sell-side Analyst"))).alias("speaker_type"))


@query(r"SELECT doc_id, regexp_matches(split_part(text, chr(10), 1), '^\s*(\[.*?\]|duration:.*)\s*$', 'is') AS noise, trim(regexp_replace(text, '\s+', ' ', 'g')) = text AS clean FROM documents")
def noise_and_space(spark, d):
    return docs(spark, d).select("doc_id", F.exists(F.split("text", "\n"), T.is_noise).alias("noise"), (T.squeeze(F.col("text")) == F.col("text")).alias("clean"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, o_custkey || '_' || o_orderdate::DATE AS call_id, translate('BRK.A/' || o_custkey, './', '--') AS symbol FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def label_and_keys(spark, d):
    li, o = A.table(spark, d, "lineitem"), A.table(spark, d, "orders")
    label = F.when(F.col("l_returnflag") == "A", "low").when(F.col("l_returnflag") == "N", "neutral").otherwise("high")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", T.label_index(label).alias("label"), T.call_id(F.col("o_custkey").cast("string"), F.to_date("o_orderdate")).alias("call_id"),
        T.symbol(F.concat(F.lit("BRK.A/"), F.col("o_custkey").cast("string"))).alias("symbol"),
    )


PRED_SQL = f"{SCORE_SQL}, pred AS (SELECT d.doc_id, l.quality, l.toxic, sum(certainty)::DOUBLE - sum(hedging)::DOUBLE AS net FROM scores d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL)"


def quality_scores(spark, d) -> DataFrame:
    net = labelled(spark, d).groupBy("doc_id").agg((F.sum("certainty") - F.sum("hedging")).alias("net"))
    return net.join(A.table(spark, d, "labels"), "doc_id")


@query(f"WITH {PRED_SQL} SELECT quality, (net > 0)::INT AS pred, count(*) AS n FROM pred GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return scoring.confusion(quality_scores(spark, d).withColumn("pred", (F.col("net") > 0).cast("int")), "quality")


@query(f"""WITH {PRED_SQL}, c AS (SELECT quality::INT AS t, (net > 0)::INT AS p, count(*) AS n FROM pred GROUP BY 1, 2), lab AS (SELECT DISTINCT t AS label FROM c UNION SELECT DISTINCT p FROM c),
k AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE t = label AND p = label), 0) AS hit, coalesce((SELECT sum(n) FROM c WHERE p = label), 0) AS called, coalesce((SELECT sum(n) FROM c WHERE t = label), 0) AS support FROM lab)
SELECT label, round(coalesce(hit / nullif(called, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hit / nullif(called + support, 0), 0), 6) AS f1, support::BIGINT AS support FROM k""")
def classification_report(spark, d):
    s = quality_scores(spark, d).withColumn("pred", (F.col("net") > 0).cast("int"))
    return scoring.classification_report(scoring.confusion(s, "quality"), "quality").select("label", *r("precision", "recall", "f1"), "support")


@query(f"""WITH {PRED_SQL}, p AS (SELECT a.net AS x, b.net AS y FROM pred a, pred b WHERE a.quality = 1 AND b.quality = 0) SELECT (SELECT count(*) FROM pred) AS n, round(avg(CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0.0 END), 6) AS auc FROM p""")
def roc_auc(spark, d):
    return scoring.roc_auc(quality_scores(spark, d), "net", F.col("quality") == 1).select("n", *r("auc"))


#: The model of model_weights and model_scores: buckets, and gradient steps over all of the training set.
FEATURES, STEPS, RATE, WARMUP, DECAY = 1 << 12, 6, 0.5, 0.1, 0.01


def _fit_sql() -> str:
    """The training set, and s{STEPS}: the weights, step by step as linear.fit takes them."""
    u, labels, states = f"{linear.UNIT}::DOUBLE", range(3), ("w0", "w1", "w2", "a0", "a1", "a2")
    fold = "0"
    for i in range(4):
        fold = f"(({fold}) * 96 + ('0x' || substr(md5(source), {8 * i + 1}, 8))::BIGINT) % 100"
    ctes = [f"""{FRAC_SQL.replace("5000.0", "860000.0")},
known AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, pos, source, sentence, weak_label, list_position(['low', 'neutral', 'high'], weak_label) - 1 AS label FROM labelled WHERE weak_label IS NOT NULL),
tokens AS (SELECT id, regexp_extract_all(lower(sentence), '[a-z'']+') AS t FROM known),
found AS MATERIALIZED (SELECT id, ('0x' || substr(md5(unnest(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]))), 1, 8))::BIGINT % {FEATURES} AS bucket FROM tokens UNION ALL SELECT id, {FEATURES} FROM known),
chosen AS MATERIALIZED (SELECT id, known.label, weak_label FROM known JOIN fractions f ON weak_label = f.label WHERE ('0x' || substr(md5(doc_id || '|' || pos), 1, 8))::BIGINT / 4294967296.0 < frac AND {fold} < 70),
weighed AS MATERIALIZED (SELECT id, label, (SELECT count(*) FROM chosen) / (3.0::DOUBLE * count(*) OVER (PARTITION BY label)) AS weight FROM chosen),
s0 AS MATERIALIZED (SELECT range AS bucket, {', '.join(f'0::DOUBLE AS {c}' for c in states)} FROM range({FEATURES + 1}))"""]
    for k, rate in enumerate(linear.rates(STEPS, RATE, WARMUP), 1):
        last = f"s{k - 1}"
        off = ", ".join(f"floor(weight * (exp(z{i} - m) / (exp(z0 - m) + exp(z1 - m) + exp(z2 - m)) - (label = {i})::INT) * {u} + 0.5)::BIGINT AS e{i}" for i in labels)
        sums = ", ".join(f"sum(w{i}) / {u} AS z{i}" for i in labels)
        new = ", ".join(f"floor((w{i} / {u} - {rate!r}::DOUBLE * (g{i} / (sqrt(b{i}) + {linear.LEAST!r}::DOUBLE) + {DECAY!r}::DOUBLE * (w{i} / {u}))) * {u} + 0.5) AS w{i}, b{i} AS a{i}" for i in labels)
        ctes.append(f"""z{k} AS (SELECT *, greatest(z0, z1, z2) AS m FROM (SELECT id, {sums} FROM found JOIN {last} USING (bucket) WHERE id IN (SELECT id FROM weighed) GROUP BY id) JOIN weighed USING (id)),
e{k} AS MATERIALIZED (SELECT id, {off} FROM z{k}),
g{k} AS (SELECT bucket, {', '.join(f"sum(e{i})::DOUBLE / ({u} * (SELECT count(*) FROM weighed)) AS g{i}" for i in labels)} FROM found JOIN e{k} USING (id) GROUP BY bucket),
b{k} AS (SELECT *, {', '.join(f'a{i} + g{i} * g{i} AS b{i}' for i in labels)} FROM (SELECT s.*, {', '.join(f'coalesce(g{i}, 0::DOUBLE) AS g{i}' for i in labels)} FROM {last} s LEFT JOIN g{k} USING (bucket))),
s{k} AS MATERIALIZED (SELECT bucket, {new} FROM b{k})""")
    return ",\n".join(ctes)


def fitted(spark, d) -> tuple[linear.LinearModel, DataFrame]:
    """The model, fitted to the whole training set, and all sentences with a label."""
    x = labelled(spark, d).filter("weak_label is not null").select("doc_id", "pos", "sentence", "weak_label", "call_id").cache()  # read for shares, class weights, the fit and the scores
    training = sentences.training_sets(x, ["doc_id", "pos"]).filter("split = 'train'")
    return linear.fit(training, FEATURES, STEPS, RATE, WARMUP, DECAY), x


@query(f"WITH {_fit_sql()} SELECT bucket::INT AS bucket, w0::BIGINT AS w_low, w1::BIGINT AS w_neutral, w2::BIGINT AS w_high FROM s{STEPS}")
def model_weights(spark, d):
    return fitted(spark, d)[0].table(spark)


@query(f"""WITH {_fit_sql()}, z AS (SELECT id, sum(w0) AS z0, sum(w1) AS z1, sum(w2) AS z2 FROM found JOIN s{STEPS} USING (bucket) GROUP BY id)
SELECT weak_label, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 'low' WHEN z1 >= z2 THEN 'neutral' ELSE 'high' END AS pred, count(*) AS n FROM z JOIN known USING (id) GROUP BY 1, 2""")
def model_scores(spark, d):
    """Fits the model as the stages do and scores all sentences with a label."""
    model, x = fitted(spark, d)
    return scoring.confusion(scoring.with_confidence(model(x.select("sentence", "weak_label"))))


def _mask_sql(s: str) -> str:
    for p in sorted([*_L.certainty_phrases, *_L.hedge_phrases, *_L.soft_phrases], key=len, reverse=True):
        s = f"regexp_replace({s}, '{p}', '[MASK]', 'gi')"
    words = ", ".join(f"'{w}'" for w in _L.cue_words())
    return f"array_to_string(list_transform(regexp_extract_all({s}, '[A-Za-z'']+|[^A-Za-z'']+'), lambda x: CASE WHEN lower(x) IN ({words}) THEN '[MASK]' ELSE x END), '')"


@query(rf"""WITH {SCORE_SQL}, m AS (SELECT weak_label, lower(trim(regexp_replace({_mask_sql('sentence')}, '\s+', ' ', 'g'))) AS s FROM labelled WHERE weak_label IN ('low', 'high')),
k AS (SELECT weak_label, s, regexp_extract_all(s, '[a-z'']+') AS t FROM m),
z AS (SELECT weak_label, (len(list_filter(t, lambda w: w = 'is')) + 0.5 * len(list_filter(t, lambda w: w IN ('and', 'will'))) + {_phr(_L.certainty_phrases)})::DOUBLE AS c,
  (len(list_filter(t, lambda w: w IN ('of', 'for', 'to', 'that'))) + 0.5 * len(list_filter(t, lambda w: w IN ('with', 'was'))) + {_phr(_L.hedge_phrases)} + {_phr(_L.soft_phrases, 0.5)})::DOUBLE AS h FROM k),
v AS (SELECT c, h, count(*) FILTER (weak_label = 'high') AS pos, count(*) FILTER (weak_label = 'low') AS neg FROM z GROUP BY 1, 2),
o AS (SELECT *, exp(c) / (exp(h) + exp(0.5) + exp(c)) - exp(h) / (exp(h) + exp(0.5) + exp(c)) AS conf, 0.5 > h AND 0.5 >= c AS neutral FROM v),
b AS (SELECT conf, sum(pos) AS pos, sum(neg) AS neg, coalesce(sum(sum(neg)) OVER (ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM o GROUP BY 1)
SELECT (SELECT sum(pos + neg) FROM v)::BIGINT AS n, (SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))::DOUBLE, 6) FROM b) AS auc, (SELECT round((sum(pos + neg) FILTER (neutral))::DOUBLE / sum(pos + neg), 6) FROM o) AS neutral_share""")
def masked_context_check(spark, d):
    """By the lexicon itself, so what it tells is that no cue is left: the share of neutral is 1 but for phrases that masks make."""
    return scoring.context_check(labelled(spark, d).select("doc_id", "pos", "sentence", "weak_label"), scoring.lexicon_scorer(_L), _L).select("n", *r("auc", "neutral_share"))


@query(f"""WITH {PRED_SQL}, c AS (SELECT quality::INT AS t, (net > 0)::INT AS p, count(*) AS n FROM pred GROUP BY 1, 2), lab AS (SELECT DISTINCT t AS label FROM c),
f AS (SELECT label, 2.0 * coalesce((SELECT sum(n) FROM c WHERE t = label AND p = label), 0) / (coalesce((SELECT sum(n) FROM c WHERE p = label), 0) + (SELECT sum(n) FROM c WHERE t = label)) AS f1, (SELECT sum(n) FROM c WHERE t = label) AS support FROM lab)
SELECT (SELECT sum(n) FROM c)::BIGINT AS n, round((SELECT sum(n) FILTER (t = p) / sum(n) FROM c)::DOUBLE, 6) AS accuracy, round(avg(f1)::DOUBLE, 6) AS macro_f1, round((max(support) / sum(support))::DOUBLE, 6) AS majority_baseline FROM f""")
def overall_metrics(spark, d):
    s = quality_scores(spark, d).withColumn("pred", (F.col("net") > 0).cast("int"))
    return scoring.overall(scoring.confusion(s, "quality"), "quality").select("n", *r("accuracy", "macro_f1", "majority_baseline"))
