"""Turns, pages and the crawl's bookkeeping as queries, each with its SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.operators import turns as U
from earshot.plans import analogues as A
from earshot.sources import crawl, lexicon, pages, tables
from earshot.streaming import incremental

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(rf"""WITH {A.TURNS_SQL}, f AS (SELECT *, coalesce(min(turn) FILTER (kind <> 'operator' AND w >= {A.REMARKS}) OVER c, 0) AS first FROM turns WINDOW c AS (PARTITION BY call)),
q AS (SELECT *, min(turn) FILTER (turn > first AND regexp_matches(text, '\b(the|der|les|que)\b', 'i')) OVER (PARTITION BY call) AS cue FROM f),
a AS (SELECT *, min(turn) FILTER (kind = 'analyst' AND turn >= coalesce(cue, 0)) OVER (PARTITION BY call) AS analyst FROM q),
s AS (SELECT *, CASE WHEN cue IS NULL THEN coalesce(analyst, max(turn) OVER (PARTITION BY call) + 1)
   WHEN analyst IS NOT NULL THEN CASE WHEN analyst > cue AND max(w) FILTER (turn = analyst - 1) OVER (PARTITION BY call) < {A.HANDOFF} THEN analyst - 1 ELSE analyst END
   ELSE cue + (max(w) FILTER (turn = cue) OVER (PARTITION BY call) >= {A.HANDOFF})::INT END AS start FROM a),
h AS (SELECT *, max((kind = 'analyst' AND turn < start)::INT) OVER (PARTITION BY call, CASE WHEN kind = 'analyst' THEN 'pat user' ELSE lower(speaker) END) AS host FROM s)
SELECT call, turn, CASE WHEN turn < start THEN 'prepared' ELSE 'qna' END AS section, CASE WHEN host = 1 THEN 'Investor Relations (unlisted)' ELSE role END AS role FROM h""")
def qna_split(spark, d):
    return U.split_qna(A.turns(spark, d), "call", A.CUE, A.REMARKS, A.HANDOFF).select("call", "turn", "section", "role")


@query(rf"""WITH {A.TURNS_SQL}, f AS (SELECT *, min(turn) FILTER (regexp_matches(text, '\b(the|die|des)\b', 'i')) OVER (PARTITION BY call) AS first FROM turns),
l AS (SELECT *, max((role = 'Analyst' AND coalesce(turn < first, true) AND w >= 8)::INT) OVER (PARTITION BY call, speaker) AS long FROM f) SELECT call, turn, CASE WHEN long = 1 THEN 'Executive (unlisted)' ELSE role END AS role FROM l""")
def unlisted_mgmt(spark, d):
    return U.unlisted_management(A.turns(spark, d), "call", 8, A.FIRST).select("call", "turn", "role")


ROLE_SQL = r"""
people AS (SELECT n_regionkey::BIGINT AS call, n_nationkey AS pos, 'role ' || n_nationkey AS role, lower(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) AS f, CASE WHEN n_nationkey % 3 = 0 THEN 'lee' ELSE 'kim' || chr(97 + n_nationkey % 26) END AS l FROM nation),
keyed AS (SELECT call, f || ' ' || l AS key, l, arg_max(role, pos) AS role FROM people GROUP BY ALL),
lone AS (SELECT call, l, any_value(role) AS only_ FROM keyed GROUP BY ALL HAVING count(*) = 1),
said AS (SELECT c_custkey, (c_custkey % 5)::BIGINT AS call, n.n_nationkey, CASE WHEN c_custkey % 2 = 0 THEN lower(regexp_replace(n.n_name, '[^A-Za-z]', '', 'g')) ELSE 'jo' END AS f, CASE WHEN n.n_nationkey % 3 = 0 THEN 'lee' ELSE 'kim' || chr(97 + n.n_nationkey % 26) END AS l
  FROM customer JOIN nation n ON c_nationkey = n.n_nationkey)"""


@query(f"WITH {ROLE_SQL} SELECT c_custkey, coalesce(k.role, o.only_) AS listed_role FROM said s LEFT JOIN keyed k ON s.call = k.call AND s.f || ' ' || s.l = k.key LEFT JOIN lone o ON s.call = o.call AND s.l = o.l")
def role_lookup(spark, d):
    n = A.table(spark, d, "nation")
    last = F.when(F.col("n_nationkey") % 3 == 0, "Lee").otherwise(F.concat(F.lit("Kim"), F.char(F.lit(97) + F.col("n_nationkey") % 26)))
    people = n.select(F.col("n_regionkey").cast("long").alias("call"), F.col("n_nationkey").alias("pos"), F.concat_ws(" ", F.regexp_replace("n_name", "[^A-Za-z]", ""), F.lit("Q."), last).alias("name"), F.concat(F.lit("role "), F.col("n_nationkey").cast("string")).alias("role"))
    c = A.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    first = F.when(F.col("c_custkey") % 2 == 0, F.regexp_replace("n_name", "[^A-Za-z]", "")).otherwise("Jo")
    said = c.select("c_custkey", (F.col("c_custkey") % 5).alias("call"), F.concat_ws(" ", first, last).alias("speaker"))
    return U.lookup_roles(said, people).select("c_custkey", "listed_role")


DEDUPE_SQL = "recs AS (SELECT o_orderkey AS seq, 'C' || o_custkey AS ticker, date_trunc('month', o_orderdate)::DATE AS call_date, o_orderdate::DATE AS published, o_orderstatus <> 'P' AS ok FROM orders), ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, call_date ORDER BY published, seq) AS rn FROM recs)"


def records(spark, d):
    return A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.trunc("o_orderdate", "month").alias("call_date"), F.to_date("o_orderdate").alias("published"),
        (F.col("o_orderstatus") != "P").alias("ok"), F.lit(None).cast("string").alias("error"), (F.col("o_orderstatus") == "F").alias("both_sections"),
    )


@query(f"WITH {DEDUPE_SQL} SELECT seq, ok AND rn = 1 AS ok, CASE WHEN ok AND rn > 1 THEN 'duplicate' END AS error FROM ranked")
def dedupe_first_published(spark, d):
    return U.first_published(records(spark, d)).select("seq", "ok", "error")


@query(f"WITH {DEDUPE_SQL} SELECT count(*) AS pages, (SELECT round(avg((o_orderstatus = 'F')::INT), 6) FROM orders) AS both_share, count(*) FILTER (ok AND rn = 1) AS calls, count(DISTINCT ticker) FILTER (ok AND rn = 1) AS tickers FROM ranked")
def parse_stats(spark, d):
    return U.parse_summary(U.first_published(records(spark, d))).withColumn("both_share", F.round("both_share", 6))


@query(f"WITH {DEDUPE_SQL} SELECT CASE WHEN ok THEN 'duplicate' ELSE 'short section or no date/ticker' END AS reason, count(*) AS n FROM ranked WHERE NOT (ok AND rn = 1) GROUP BY 1")
def drop_reasons(spark, d):
    return U.drop_reasons(U.first_published(records(spark, d)))


@query(rf"""WITH {A.TURNS_SQL}, p AS (SELECT call, coalesce(sum(w) FILTER (kind = 'executive' AND turn < 3), 0) AS prepared_words, coalesce(sum(w) FILTER (kind = 'executive' AND turn >= 3), 0) AS qna_words FROM turns GROUP BY 1)
SELECT call, prepared_words::BIGINT AS prepared_words, qna_words::BIGINT AS qna_words, least(prepared_words, qna_words) > 0 AS both_sections, least(prepared_words, qna_words) >= 50 AS ok FROM p""")
def section_words(spark, d):
    t = A.turns(spark, d).withColumns({"section": F.when(F.col("turn") < 3, "prepared").otherwise("qna"), "speaker_type": T.speaker_type(F.col("speaker"), F.col("role"))})
    rec = t.select("call").distinct().withColumns({"ticker": F.lit("T"), "call_date": F.lit("D"), "error": F.lit(None).cast("string")})
    return U.parse_stats(rec, t, "call", 50).select("call", "prepared_words", "qna_words", "both_sections", "ok")


@query("SELECT page_id, 'pages/' || substr(sha1(url), 1, 2) || '/' || sha1(url) || '.html.gz' AS path FROM pages")
def url_page_path(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.page_path(F.col("url")).alias("path"))


INDEX_SQL = "idx AS (SELECT event_id AS seq, 'u/' || user_id AS url, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'missing' ELSE 'ok' END AS status FROM events)"


def index(spark, d):
    return A.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("url"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "missing").otherwise("ok").alias("status"))


@query(f"WITH {INDEX_SQL} SELECT url, max(seq) AS seq, arg_max(status, seq) AS status, min(seq) AS first_seq FROM idx GROUP BY 1")
def index_last_write_wins(spark, d):
    return crawl.latest_records(index(spark, d)).select("url", "seq", "status", "first_seq")


@query(f"WITH {INDEX_SQL}, l AS (SELECT url, arg_max(status, seq) AS status FROM idx GROUP BY 1), u AS (SELECT 'u/' || c_custkey AS url, c_nationkey::VARCHAR AS published FROM customer) SELECT url, published FROM u WHERE url NOT IN (SELECT url FROM l WHERE status <> 'error')")
def pending_anti_join(spark, d):
    urls = A.table(spark, d, "customer").select(F.concat(F.lit("u/"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_nationkey").cast("string").alias("published"))
    return crawl.pending(urls, index(spark, d))


@query("""WITH c AS (SELECT CASE WHEN l_suppkey % 7 = 0 THEN 'HOT' ELSE 'K' || l_partkey END AS call FROM lineitem), s AS (SELECT call, count(*) AS n, md5('=' || call) AS key FROM c GROUP BY 1),
b AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % greatest(1, (SELECT count(*) FROM s) // 100) AS bucket, CASE WHEN n < 500 THEN n ELSE 0 END AS small FROM s)
SELECT call, n, CASE WHEN n < 500 THEN lpad((coalesce(sum(small) OVER (ORDER BY bucket, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500)::BIGINT::VARCHAR, 9, '0') ELSE 'call-' || key END AS part FROM b""")
def part_numbers(spark, d):
    """Parts of about 500 rows; a call with a seventh of all rows has one to itself."""
    call = F.when(F.col("l_suppkey") % 7 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("K"), F.col("l_partkey").cast("string")))
    return tables.call_parts(A.table(spark, d, "lineitem").select(call.alias("call")), "call", rows=500, bucket_calls=100)


@query(f"WITH {INDEX_SQL} SELECT status, count(*) AS n FROM idx GROUP BY 1")
def status_counts(spark, d):
    return crawl.status_counts(index(spark, d))


@query("SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH))::DATE AS month")
def month_range(spark, d):
    """All months from the first to the last order."""
    a, b = A.table(spark, d, "orders").agg(*(F.date_format(f("o_orderdate"), "yyyy-MM") for f in (F.min, F.max))).first()
    return crawl.months(spark, a, b)


@query(r"""WITH m AS (SELECT page_id AS seq, 'x https://example.com/t/' || (2017 + page_id % 3) || '/0' || (1 + page_id % 9) || '/1' || (page_id % 10) || '/' || (page_id % 40) || '-a < y' AS xml FROM pages),
f AS (SELECT seq, regexp_extract(xml, 'https://example\.com/t/\d{4}/\d{2}/\d{2}/[^<\s"]+') AS url FROM m) SELECT DISTINCT url, regexp_extract(url, '/t/(\d{4})', 1) || '-' || regexp_extract(url, '/t/\d{4}/(\d{2})', 1) || '-' || regexp_extract(url, '/t/\d{4}/\d{2}/(\d{2})', 1) AS published FROM f""")
def sitemap_discovery(spark, d):
    k = F.col("page_id")
    xml = F.concat(F.lit("x https://example.com/t/"), (2017 + k % 3).cast("string"), F.lit("/0"), (1 + k % 9).cast("string"), F.lit("/1"), (k % 10).cast("string"), F.lit("/"), (k % 40).cast("string"), F.lit("-a < y"))
    maps = A.table(spark, d, "pages").select(k.alias("seq"), xml.alias("xml"))
    return crawl.discover(maps, r'https://example\.com/t/(\d{4})/(\d{2})/(\d{2})/[^<\s"]+')


@query("""WITH w AS (SELECT DISTINCT p_brand || p_size AS word, (p_size % 4)::INT AS modal, (p_size % 3)::INT AS uncertainty FROM part)
SELECT lower(word) AS word, CASE modal WHEN 1 THEN 'strong' WHEN 2 THEN 'moderate' ELSE 'weak' END AS class FROM w WHERE modal > 0
UNION SELECT lower(word), 'uncertainty' FROM w WHERE uncertainty > 0 AND word NOT IN (SELECT word FROM w WHERE modal = 3)""")
def lexicon_classes(spark, d):
    p = A.table(spark, d, "part")
    words = p.select(F.lower(F.concat("p_brand", F.col("p_size").cast("string"))).alias("word"), (F.col("p_size") % 4).cast("int").alias("modal"), (F.col("p_size") % 3).cast("int").alias("uncertainty")).distinct()
    return lexicon.classify(words)


#: Heads made of a page's id, in place of downloaded ones: tickers and companies, some without, and a quarter in most titles.
HEAD = "<html><head><meta name='primary_tickers' content=' t{id}, other'><meta name='primary_tickers_companies' content='Firm {id} Ltd, Other'><title>Firm {id} q{q} {fy}{y} results | Wire</title></head><body>x</body></html>"


def filled(template: str, **by) -> F.Column:
    """template with {name} replaced by columns."""
    out = F.lit(template)
    for name, c in by.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'T' || page_id END AS ticker, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'Firm ' || page_id || ' Ltd' END AS company,
CASE WHEN page_id % 5 = 0 THEN regexp_replace(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '^\\s+|\\s+$', '', 'g') ELSE 'Firm ' || page_id || ' q' || (1 + page_id % 5) || ' ' || CASE WHEN page_id % 2 = 0 THEN 'FY ' ELSE '' END || (1990 + page_id % 40) || ' results' END AS title,
CASE WHEN page_id % 5 IN (0, 4) THEN '' ELSE 'Q' || (1 + page_id % 5) || ' ' || (1990 + page_id % 40) END AS fiscal_quarter FROM pages""")
def html_metadata(spark, d):
    k = F.col("page_id")
    made = filled(HEAD, id=k, q=1 + k % 5, fy=F.when(k % 2 == 0, "FY ").otherwise(""), y=1990 + k % 40)
    x = A.table(spark, d, "pages").select("page_id", F.when(k % 5 == 0, F.col("html")).otherwise(made).alias("html"))
    return pages.extract_metadata(x, title_suffix="| Wire").select("page_id", "ticker", "company", "title", "fiscal_quarter")


#: Transcripts made of a page's id, in place of downloaded ones: with a heading for each section, and with a list of people.
HEADED = (
    "<html><body><p>Wire</p><div class='x article-body'><p>Northwind {id} results call<br>{date} at 7:{m} p.m. ET</p><h2>Contents</h2><p><strong>Nobody</strong> -- <em>none</em></p>"
    "<h2>Prepared <i>remarks</i></h2><p><strong>Ona Vik</strong> -- <em>Treasurer</em></p><p>Plan {id} goes on.</p><p>[music]</p><p>It is funded.</p><h2>Questions and answers</h2>"
    "<p><strong>Ivo Tam</strong> -- <em>Lead Analyst</em></p><p>Is {id} enough?</p><p><strong>Operator</strong></p><p>One more.</p><p><strong>Duration: 9 minutes</strong></p><p>Bye.</p>"
    "<h2>Call participants</h2><p><strong>Ona Vik</strong> -- <em>Treasurer</em></p></div></body></html>"
)
LISTED = (
    "<html><body><div id='article-body-transcript'><span id='date'>{date}</span> <em id='time'>8 a.m.</em><h2 id='call-participants'>Who spoke</h2><ul><li>Treasurer of all — Una Q. Vale</li><li>Nobody</li></ul>"
    "<p>Head of Sales - Odd Nord</p><h2 id='full-conference-call-transcript'>All of it</h2><p>Before.</p><p><strong>Una Vale:</strong> Good day from {id}.</p><p>Costs fell.</p>"
    "<p><strong>Operator:</strong> The first question, please.</p><p><strong>Kit Oz:</strong> Why {id}?</p><p><strong>Erik Nord:</strong> <strong>As</strong> planned.</p><p><strong>No name. At all:</strong> so.</p>"
    "<h2 id='more'>More</h2><p><strong>Ad:</strong> no</p></div></body></html>"
)
_MONTH = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'June', 'July', 'Aug', 'Sept', 'Oct', 'Nov', 'December'][1 + page_id % 12]"
_DAY = "'2021-' || lpad((1 + page_id % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0')"


def dated(template: str) -> F.Column:
    k = F.col("page_id")
    names = F.array(*map(F.lit, ("Jan", "Feb", "Mar", "Apr", "May", "June", "July", "Aug", "Sept.", "Oct", "Nov.", "December")))
    day = F.concat(F.element_at(names, (1 + k % 12).cast("int")), F.lit(" "), (1 + k % 28).cast("string"), F.lit(", 2021"))
    return filled(template, id=k, date=day, m=10 + k % 50)


@query(f"""WITH p AS (SELECT page_id AS id, {_DAY} AS day, '19:' || (10 + page_id % 50) AS clock FROM pages)
SELECT id AS page_id, turn, section, speaker, speaker_type, role, text, day AS call_date, call_time_et FROM (
SELECT id, day, clock AS call_time_et, unnest([
  {{turn: 0, section: 'prepared', speaker: 'Ona Vik', speaker_type: 'executive', role: 'Treasurer', text: 'Plan ' || id || ' goes on. It is funded.'}},
  {{turn: 1, section: 'qna', speaker: 'Ivo Tam', speaker_type: 'analyst', role: 'Lead Analyst', text: 'Is ' || id || ' enough?'}},
  {{turn: 2, section: 'qna', speaker: 'Operator', speaker_type: 'operator', role: 'Operator', text: 'One more. Bye.'}}], recursive := true) FROM p WHERE id % 2 = 0
UNION ALL SELECT id, day, '08:00', unnest([
  {{turn: 0, section: 'prepared', speaker: 'Una Vale', speaker_type: 'executive', role: 'Treasurer of all', text: 'Good day from ' || id || '. Costs fell.'}},
  {{turn: 1, section: 'qna', speaker: 'Operator', speaker_type: 'operator', role: 'Operator', text: 'The first question, please.'}},
  {{turn: 2, section: 'qna', speaker: 'Kit Oz', speaker_type: 'analyst', role: 'Analyst', text: 'Why ' || id || '?'}},
  {{turn: 3, section: 'qna', speaker: 'Erik Nord', speaker_type: 'executive', role: 'Head of Sales', text: 'As planned. No name. At all: so.'}}], recursive := true) FROM p WHERE id % 2 = 1)""")
def html_extract(spark, d):
    html = F.when(F.col("page_id") % 2 == 0, dated(HEADED)).otherwise(dated(LISTED))
    blocks = pages.read_blocks(A.table(spark, d, "pages").select("page_id", html.alias("html")), "page_id")
    return U.speaker_turns(blocks, "page_id").select("page_id", "turn", "section", "speaker", "speaker_type", "role", "text", "call_date", "call_time_et")


@query(f"""SELECT page_id, CASE WHEN page_id % 7 IN (1, 5) THEN NULL ELSE 'ValueError' END AS error, CASE page_id % 7 WHEN 1 THEN 'legacy' WHEN 5 THEN 'current' END AS layout,
CASE WHEN page_id % 7 = 1 THEN {_DAY} END AS call_date, CASE page_id % 7 WHEN 1 THEN 17 WHEN 5 THEN 14 ELSE 0 END AS blocks FROM pages""")
def html_robustness(spark, d):
    """Pages as they are (without an article), whole ones, none, impossible days, unknown months, no date, no transcript."""
    k, day = F.col("page_id") % 7, lambda x: F.replace(F.lit(HEADED), F.lit("{date}"), F.lit(x))
    html = (
        F.when(k == 0, F.col("html")).when(k == 1, dated(HEADED)).when(k == 3, day("Feb. 29, 2021")).when(k == 4, day("Mai 3, 2021"))
        .when(k == 5, F.replace(F.lit(LISTED), F.lit("{date}"), F.lit("a day in June"))).when(k == 6, "<div class='article-body'><h2>Remarks</h2><p>x</p></div>")
    )
    blocks = pages.read_blocks(A.table(spark, d, "pages").select("page_id", html.alias("html")), "page_id")
    return pages.page_records(blocks, "page_id").select("page_id", "error", "layout", "call_date", "blocks")


@query(f"""WITH {INDEX_SQL}, l AS (SELECT url, arg_max(status, seq) AS status FROM idx GROUP BY 1) SELECT c_custkey, url, CASE WHEN c_nationkey IN (3, 7) THEN 'ok' ELSE 'skipped' END AS status FROM
(SELECT c_custkey, 'u/' || c_custkey AS url, c_nationkey FROM customer) WHERE url NOT IN (SELECT url FROM l WHERE status <> 'error')""")
def ticker_filter(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("u/"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_nationkey").cast("string").alias("published"))
    todo = crawl.pending(c, index(spark, d)).withColumns({"status": F.lit("ok"), "ticker": F.concat(F.lit("N"), "published")})
    return crawl.only_tickers(todo, ["N3", "n7"]).select("c_custkey", "url", "status")


@query("""WITH m AS (SELECT unnest(generate_series(DATE '1992-01-01', DATE '1998-12-01', INTERVAL 1 MONTH))::DATE AS month) SELECT month FROM m
WHERE month >= DATE '1998-03-01' OR month NOT IN (SELECT date_trunc('month', o_orderdate)::DATE FROM orders WHERE o_orderkey % 97 = 0)""")
def sitemap_cache(spark, d):
    cached = A.table(spark, d, "orders").filter("o_orderkey % 97 = 0").select(F.trunc("o_orderdate", "month").alias("month"))
    return crawl.sitemaps_to_fetch(crawl.months(spark, "1992-01", "1998-12"), cached, datetime.date(1998, 3, 9))


@query("""WITH parts AS (SELECT 'p' || l_orderkey AS path, max(l_shipdate) AS modified FROM lineitem GROUP BY 1),
done AS (SELECT 'p' || o_orderkey AS path, o_orderdate + INTERVAL 60 DAY AS scored_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 90 DAY ELSE o_orderdate END AS model_at FROM orders WHERE o_orderkey % 3 <> 0)
SELECT path, modified::DATE AS modified FROM parts WHERE path NOT IN (SELECT p.path FROM parts p JOIN done d ON p.path = d.path WHERE p.modified <= d.scored_at AND d.model_at <= d.scored_at)""")
def stale_parts(spark, d):
    path = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias("path")
    parts = A.table(spark, d, "lineitem").groupBy(path("l_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("modified"))
    o = A.table(spark, d, "orders").filter("o_orderkey % 3 <> 0").withColumn("day", F.to_date("o_orderdate"))
    manifest = o.select(path("o_orderkey"), F.date_add("day", 60).alias("scored_at"), F.when(F.col("o_orderstatus") == "P", F.date_add("day", 90)).otherwise(F.col("day")).alias("model_at"))
    return incremental.stale_parts(parts, manifest)
