import gzip
import random

import pytest
from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.operators import turns as U
from earshot.sources import crawl, pages


def listed(*said: tuple[str, str], people: str = "", date: str = "<h2 id='date'>When</h2><p>Monday, March 6, 2023, 6:45 a.m. in Oslo</p>") -> str:
    """A page with a list of people and one long section: (label or "", text) a paragraph."""
    lines = "".join(f"<p><strong>{who}:</strong> {text}</p>" if who else f"<p>{text}</p>" for who, text in said)
    return f"<body><div id='{pages.BODY_ID}'>{date}<h2 id='{pages.PARTICIPANTS_ID}'>Voices</h2>{people}<h2 id='{pages.TRANSCRIPT_ID}'>Words</h2>{lines}<h2>See also</h2><p><strong>Shop:</strong> sale</p></div></body>"


def headed(body: str) -> str:
    return f"<body><div class='wide {pages.BODY_CLASS}'><p>Kestrel Mining call of Nov. 11, 2020</p>{body}</div></body>"


def turns(spark, source: str | None):
    df = spark.createDataFrame([(source,)], "html string").withColumn("url", F.lit("u"))
    return U.speaker_turns(pages.read_blocks(df)).orderBy("turn").collect()


def test_people_of_a_list(spark):
    people = "<ul><li>Director -- of the <b>Works</b> – Runa Dahl</li><li>Counsel-Runa Holm</li><li>Pilot — Mads Berg</li><li>Chief Pilot — Mads B. Berg</li></ul><p>Cook - Tor Lie</p><div><p>Hidden - Per Moe</p></div>"
    said = [("Runa Dahl", "We dug."), ("", "[applause]"), ("", "Deep."), ("Mads Berg", "I flew."), ("Anna Lie", "I cooked?"), ("Per Moe", "And I?"), ("Operator Two", "That was it.")]
    got = turns(spark, listed(*said, people=people))
    assert [(r["speaker"], r["role"], r["speaker_type"], r["text"]) for r in got] == [
        ("Runa Dahl", "Director of the Works", "executive", "We dug. Deep."), ("Mads Berg", "Chief Pilot", "executive", "I flew."), ("Anna Lie", "Cook", "executive", "I cooked?"),
        ("Per Moe", U.HOST if got[3]["section"] == "prepared" else "Analyst", "analyst" if got[3]["section"] == "qna" else "executive", "And I?"), ("Operator Two", "Operator", "operator", "That was it."),
    ]
    assert {(r["layout"], r["call_date"], r["call_time_et"]) for r in got} == {("current", "2023-03-06", "06:45")}


@pytest.mark.parametrize("label, begins", [("Runa", True), ("a b c d e f g", True), ("a b c d e f g h", False), ("Room 9", False), ("Yes. And no", False), ("U.S. desk", False), ("Dr.Who", True)])
def test_only_names_begin_a_turn(spark, label, begins):
    got = turns(spark, listed(("Host", "Hello."), (label, "It is so.")))
    assert [r["text"] for r in got] == (["Hello.", "It is so."] if begins else [f"Hello. {label}: It is so."])


def test_sections_of_headings(spark):
    body = """<h2>Prepared Remarks by all</h2><p>Nobody said this.</p><p><strong>Siv Ask</strong> -- <em>Geologist</em></p><p>Ore <i>is</i><b>there</b>.</p><p>duration: 3 min</p><p><strong>Bold</strong> words go on.</p>
<h2>An aside</h2><p>Still remarks.</p><p><strong>Operator</strong></p><p>Next.</p><h2>QUESTIONS</h2><p><strong>Duration 4</strong> -- <em>x</em></p><p>More of it.</p><p><strong>Ulf Rye</strong> -- Guest</p><p>How much?</p>
<p><strong>Siv Ask</strong></p><p>Enough.</p><h2>Call Participants and more</h2><p><strong>Ulf Rye</strong> -- <em>Analyst</em></p><p>Not said.</p>"""
    got = [(r["section"], r["speaker"], r["role"], r["text"]) for r in turns(spark, headed(body))]
    assert got == [
        ("prepared", "Siv Ask", "Geologist", "Ore is there . Bold words go on. Still remarks."), ("prepared", "Operator", "Operator", "Next. More of it."), ("qna", "Ulf Rye", "", "How much?"), ("qna", "Siv Ask", "", "Enough."),
    ]


def test_remarks_alone_are_split_by_cues(spark):
    body = "<h2>Prepared Remarks</h2><p><strong>Siv Ask</strong> -- <em>Geologist</em></p><p>" + "ore " * 160 + "</p><p><strong>Operator</strong></p><p>The next question.</p><p><strong>Ulf Rye</strong> -- <em>Analyst</em></p><p>Why?</p>"
    assert [r["section"] for r in turns(spark, headed(body))] == ["prepared", "qna", "qna"]


def test_unreadable_pages(spark, tmp_path):
    good = listed(("Runa", "Yes."), ("Tor", "No."))
    files = {"a/ok": gzip.compress(good.encode()), "a/plain": b"<p>x</p>", "b/cut": gzip.compress(good.encode())[:40], "b/none": gzip.compress(b"<p>x</p>"), "b/no_words": gzip.compress(f"<div id='{pages.BODY_ID}'><h2>x</h2></div>".encode())}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.html.gz").write_bytes(data)
    got = pages.page_records(pages.read_blocks(pages.read_gzip_pages(spark, str(tmp_path)), "path"), "path").select(F.regexp_extract("path", r"(\w/\w+)\.html", 1).alias("f"), "error", F.col("blocks").alias("n")).collect()
    assert {r["f"]: (r["error"], r["n"]) for r in got} == {"a/ok": (None, 8), "a/plain": ("BadGzipFile", 0), "b/cut": ("EOFError", 0), "b/none": ("ValueError", 0), "b/no_words": ("ValueError", 0)}


@pytest.mark.parametrize("date, want", [
    ("<span id=date>Tue, Sept. 30, 2025</span><div id=time>12:05 pm</div>", ("2025-09-30", "12:05")), ("<span id=date>December 1, 1999</span><i id=time>12 a.m.</i>", ("1999-12-01", "00:00")),
    ("<h2 id=date>May 9, 2001</h2><p>not then</p>", (None, None)), ("<p id=date>Feb 29, 2024 at 11 P.M.</p>", ("2024-02-29", "23:00")), ("<span id=date>soon</span>", (None, None)),
    ("<p>On Oct 3, 2022</p><p>Recall of Oct. 4, 2022</p><p>call on Oct. 5, 2022</p>", ("2022-10-04", None)), ("<p>x</p>" * 6 + "<p>call on Oct. 5, 2022</p>", (None, None)),
    ("<span id=date>Feb 29, 2023</span>", "ValueError"), ("<span id=date>Juin 3, 2023</span>", "ValueError"), ("<span id=date>Jun 0, 2023</span>", "ValueError"), ("<span id=date>Jun 31, 2023</span>", "ValueError"),
])
def test_day_and_time(spark, date, want):
    df = spark.createDataFrame([("u", listed(("Runa", "Yes."), date=date))], "url string, html string")
    r = pages.page_records(pages.read_blocks(df)).first()
    assert (r["error"] if r["error"] else (r["call_date"], r["call_time_et"])) == want


def slow_role(people: list[tuple[str, str]], name: str) -> str | None:
    def key(x):
        parts = "".join(c for c in x.lower() if c in "abcdefghijklmnopqrstuvwxyz ").split()
        return (parts[0], parts[-1]) if len(parts) > 1 else tuple(parts)

    roles = {key(n): r for n, r in people}
    same = [r for k, r in roles.items() if k[-1:] == key(name)[-1:]]
    return roles.get(key(name), same[0] if len(same) == 1 else None)


def test_roles_by_search(spark):
    rng = random.Random(11)
    name = lambda: f"{rng.choice(['Eli', 'Åse', 'Jo-Ann', 'Rex'])}{rng.choice([' ', ' P. ', ' van '])}{rng.choice(['Dunn', 'Ek', 'O’Hara', 'Fox'])}"
    people = [(name(), f"role {i}") for i in range(9)]
    said = sorted({name() for _ in range(60)} | {"Nobody", "Fox"})
    df = spark.createDataFrame([("c", i, n, r) for i, (n, r) in enumerate(people)], "call string, pos int, name string, role string")
    asked = spark.createDataFrame([("c", n) for n in said], "call string, speaker string")
    got = {r["speaker"]: r["listed_role"] for r in U.lookup_roles(asked, df).collect()}
    assert got == {n: slow_role(people, n) for n in said}
    listed_ = asked.withColumns({"key": T.name_key(F.col("speaker")), "people": F.array(*(F.struct(T.name_key(F.lit(n)).alias("key"), F.lit(r).alias("role")) for n, r in people))})
    assert {r["speaker"]: r["role"] for r in listed_.select("speaker", U.role_among(F.col("people"), F.col("key")).alias("role")).collect()} == got


def test_pages_are_read_once_and_keep_their_own_columns(spark):
    """Many pages at once, their columns named like the reader's; one Python node and one shuffle in the plan."""
    rows = [(i, listed(("Runa", f"Yes {i}."), ("Operator", "The next question."), ("Tor", "No.")) if i % 3 else None, f"k{i}", i, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "no long, html string, kind string, turn_no long, own0 string")
    out = U.speaker_turns(pages.read_blocks(df, "no"), "no")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {(r["no"], r["turn"]): (r["speaker"], r["text"], r["kind"], r["turn_no"], r["own0"]) for r in out.collect()}
    assert len(got) == 600 and all(got[i, 0] == ("Runa", f"Yes {i}.", f"k{i}", i, "x") for i in range(300) if i % 3)
    assert U.speaker_turns(pages.read_blocks(df.limit(0), "no"), "no").count() == 0


def slow_split(rows: list[tuple]) -> str:
    """The start of the questions by the rules as told: (is operator, is analyst, words, has cue) of each turn."""
    talk = [i for i, (op, _, w, _) in enumerate(rows) if not op and w >= U.REMARKS_WORDS]
    after = talk[0] if talk else 0
    cues = [i for i, r in enumerate(rows) if i > after and r[3]]
    asks = [i for i, r in enumerate(rows) if r[1] and i >= (cues[0] if cues else 0)]
    if cues and asks:
        short = asks[0] > cues[0] and rows[asks[0] - 1][2] < U.HANDOFF_WORDS
        start = asks[0] - short
    elif cues:
        start = cues[0] + (rows[cues[0]][2] >= U.HANDOFF_WORDS)
    else:
        start = asks[0] if asks else len(rows)
    return "p" * start + "q" * (len(rows) - start)


def test_start_of_questions_by_rules(spark):
    rng = random.Random(13)
    calls, want = [], {}
    for c in range(60):
        facts = []
        for t in range(rng.randint(1, 8)):
            op, cue, words = rng.random() < 0.25, rng.random() < 0.3, rng.choice([1, 30, 79, 80, 149, 150, 200])
            analyst = not op and rng.random() < 0.3
            text = " ".join(["Let us go to the Q&A"] * cue) or "hm"
            text += " um" * max(0, words - len(text.split()))
            facts.append((op, analyst, len(text.split()), cue))
            calls.append((f"c{c}", t, "Operator" if op else f"P{t}", "Guest Analyst" if analyst else "Chair", text))
        want[f"c{c}"] = slow_split(facts)
    got = U.split_qna(spark.createDataFrame(calls, "call string, turn int, speaker string, role string, text string")).orderBy("call", "turn").collect()
    made: dict[str, str] = {}
    for r in got:
        made[r["call"]] = made.get(r["call"], "") + r["section"][0]
    assert made == want


def test_who_asks_before_the_questions_is_a_host(spark):
    rows = [("Mia Wold", "IR Analyst", "hello all"), ("Bo", "Chair", "um " * 180), ("Operator", "Operator", "now the next question"), ("Ada", "Analyst", "so?"), ("Mia X. Wold", "Analyst", "done")]
    df = spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows)], "call string, turn int, speaker string, role string, text string")
    assert [(r["section"][0], r["role"]) for r in U.split_qna(df).orderBy("turn").collect()] == [("p", U.HOST), ("p", "Chair"), ("q", "Operator"), ("q", "Analyst"), ("q", U.HOST)]


def test_unlisted_management(spark):
    rows = [("c", 0, "M", "Analyst", "word " * 300), ("c", 1, "Op", "Operator", "the first question"), ("c", 2, "N", "Analyst", "word " * 300), ("c", 3, "M", "Analyst", "x")]
    got = U.unlisted_management(spark.createDataFrame(rows, "call string, turn int, speaker string, role string, text string")).orderBy("turn").collect()
    assert [r["role"] for r in got] == [U.UNLISTED, "Operator", "Analyst", U.UNLISTED]


def test_duplicates_and_statistics(spark):
    rows = [("a", "T", "2024-01-01", "2024-02-01", 1, False), ("b", "T", "2024-01-01", "2024-02-02", 2, True), ("c", "U", "2024-01-01", "2024-02-02", 4, True), ("d", "U", "2024-01-01", "2024-02-02", 3, True)]
    df = spark.createDataFrame(rows, "url string, ticker string, call_date string, published string, seq int, ok boolean").withColumns({"error": F.lit(None).cast("string"), "both_sections": F.col("ok")})
    got = {r["url"]: (r["ok"], r["error"]) for r in U.first_published(df).collect()}
    assert got == {"a": (False, None), "b": (False, "duplicate"), "c": (False, "duplicate"), "d": (True, None)}  # a, though not ok, keeps b out
    assert {r["reason"]: r["n"] for r in U.drop_reasons(U.first_published(df)).collect()} == {"duplicate": 2, "short section or no date/ticker": 1}


def test_metadata(spark):
    page = "<head><meta name='primary_tickers' content=' kst ,rvn'><meta name='primary_tickers_companies' content=' Kestrel Mining ,Raven'><title> Kestrel Q4&nbsp;FY 1998 - Wire </title></head>"
    got = pages.extract_metadata(spark.createDataFrame([(page,), (None,), ("<title>q2 2150</title>",)], "html string"), title_suffix="- Wire").collect()
    assert [(r["ticker"], r["company"], r["fiscal_quarter"]) for r in got] == [("KST", "Kestrel Mining", "Q4 1998"), ("", "", ""), ("", "", "")]


def test_crawl_index(spark, tmp_path):
    crawl.append_index(spark.createDataFrame([(1, "a", "error"), (2, "b", "missing"), (3, "c", "ok"), (4, "a", "ok"), (5, "c", "error"), (6, "d", "skipped")], "seq long, url string, status string"), str(tmp_path / "i"))
    index = crawl.read_index(spark, str(tmp_path / "i"))
    assert index.count() == 5
    urls = spark.createDataFrame([(u, f"2024-01-0{i}") for i, u in enumerate("abcd", 1)], "url string, published string")
    assert [r["url"] for r in crawl.pending(urls, index).collect()] == ["d", "c"]
