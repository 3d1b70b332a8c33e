import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from conftest_llm import prose
from pyspark.sql import functions as F

from earshot.llm import common, html, quality, syncmers, toxicity

PAGE = """<html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head><body class="home">
<header><div>My Site</div><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></header><nav><a href=/x>Menu entry</a></nav><div id="cookie-notice">We use cookies, ok?</div>
<div class="wrap"><div class="content"><h1>Title &amp; here</h1>%s<div class="advert">Buy now!</div><form><label>Name</label><input><button>Send</button></form></div>
<div class="sidebar"><p>Popular posts of this week are the following ones here, read them all now please</p></div></div>
<section id="comments"><article class="comment"><p>I disagree with this long reader comment that goes on and on and on and on for a while and more.</p></article></section>
<footer>&copy; copyright</footer><!-- <p>hidden</p> --></body></html>"""


def test_html_parts():
    body = "<p>First paragraph with quite some text, <a href=x>a link</a> inside.</p><p>Second  one\n with &lt;tags&gt; &#x41;&nbsp;B<br>break, long enough to be text."
    assert html.main_text(PAGE % body) == "Title & here\nFirst paragraph with quite some text, a link inside.\nSecond one with <tags> A B break, long enough to be text."
    sections = "".join(f"<div class=sec><h2>Part {i}</h2><p>{prose(i, 30)}</p><p>{prose(i + 50, 30)}</p></div>" for i in range(4))
    got = html.main_text(PAGE % sections).split("\n")
    assert len(got) == 13 and got[0] == "Title & here" and not any("Buy" in x or "disagree" in x or "Popular" in x for x in got)


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class=post>%s</div>", "<table><tr><td>%s</td></tr></table>", "<div><div><div>%s</div></div></div>"])
def test_html_layouts(wrap):
    inner = "<h1>Head line</h1><p>" + "</p><p>".join(prose(i, 25) for i in range(3)) + "</p><ul><li>one item<li>two items</ul><blockquote>Said so.</blockquote>"
    page = "<body><nav><ul>" + "<li><a href=/a>entry</a>" * 8 + "</ul></nav>" + wrap % inner + "<aside><p>Aside text is here</p></aside><footer>foot</footer></body>"
    assert html.main_text(page) == "\n".join(["Head line", *(prose(i, 25) for i in range(3)), "one item", "two items", "Said so."])


@pytest.mark.parametrize("name", ["cookiebar", "adBanner", "left-sidebar", "Comments_List", "site-header", "SIDEBAR", "newsletterBox", "user_responses"])
def test_html_names_of_parts(name):
    article = "<div class=story><h1>Head</h1><p>" + prose(1, 40) + "</p><p>" + prose(2, 40) + "</p></div>"
    part = f'<div class="{name}"><p>' + prose(3, 60) + "</p></div>"
    want = "\n".join(["Head", prose(1, 40), prose(2, 40)])
    assert html.main_text(f"<body>{part}{article}</body>") == html.main_text(f"<body>{article}{part}</body>") == want
    assert html.main_text("<body>" + article.replace("</div>", part + "</div>") + "</body>") == want


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<div class=post>%s</div>"])
def test_html_sections_named_like_parts(wrap):
    parts = ['<h1 class="page-header">Head line</h1><p class="notice">' + prose(1, 30) + "</p>", f'<h2 id="related-work">Related work</h2><p>{prose(2, 40)}</p>']
    parts += [f'<section id="discussion"><h2 class="head">Discussion</h2><p>{prose(3, 40)}</p></section>', f'<div id="social-share"><h3 id="share">Share of costs</h3><p>{prose(4, 40)}</p></div>']
    out = '<div id="related"><h3>Read on</h3><ul><li><a href=/a>Another story of ours</a><li><a href=/b>One more story of ours</a></ul></div><section id="comments"><p>I disagree</p></section><div class="share">Share this</div>'
    page = f"<body><nav><a href=/>Home</a></nav>{wrap % (''.join(parts) + out)}{out}<footer>foot</footer></body>"
    want = ["Head line", prose(1, 30), "Related work", prose(2, 40), "Discussion", prose(3, 40), "Share of costs", prose(4, 40)]
    assert html.main_text(page) == "\n".join(want)


BOXES = "notice alert banner overlay promotion recommended announcement disclaimer copyright subscription social trending".split()


@pytest.mark.parametrize("name", [*BOXES, "related", "discussion", "responses", "replies"])
@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>"])
def test_html_parts_in_an_article_by_evidence(name, wrap):
    """A part named so goes before the heading, with little text, or as readers' comments; a section of the article stays."""
    first, last = f"<h1>Head</h1><p>{prose(1, 40)}</p><p>{prose(2, 40)}</p>", f"<p>{prose(5, 40)}</p>"
    plain = ["Head", prose(1, 40), prose(2, 40), prose(5, 40)]

    def lines(before, within, after=""):
        return html.main_text("<body><nav><a href=/>Home</a></nav>" + wrap % (before + first + within + last + after) + "<footer>foot</footer></body>").split("\n")

    for tag in ("div", "section"):
        small = f"<{tag} class={name}><p>We use cookies here.</p></{tag}>"
        assert lines(small, "") == lines("", small) == lines("", "", small) == plain
        assert lines(f"<{tag} class={name}><h2>Take note</h2><p>{prose(3, 40)}</p></{tag}>", "") == plain
        said = "".join(f"<div><b>Reader {i}</b> <i>{i + 2} days ago</i><p>{prose(60 + i, 50)}</p></div>" for i in range(5))
        assert lines("", "", f"<{tag} class={name}><h3>What you think</h3>{said}</{tag}>") == plain
        own = f"<{tag} class={name}><h2>Further work</h2><p>{prose(3, 40)}</p><p>{prose(4, 40)}</p></{tag}>"
        assert lines("", own) == [*plain[:3], "Further work", prose(3, 40), prose(4, 40), plain[3]]
        bare = f"<{tag} class={name}><p>{prose(3, 40)}</p><p>{prose(4, 40)}</p></{tag}>"
        assert lines("", bare) == (plain if name in BOXES else [*plain[:3], prose(3, 40), prose(4, 40), plain[3]])


def test_html_odd(spark):
    odd = [None, "", "  ", "plain &lt;text", "<p>a<p>b", "<div><script>x", "<<<>>>", "<a title=\"x>y</a><p>q", "<p>" * 3000 + "deep" + "</div>" * 10, "<b>" * 2000 + "x", "<html></html>", "<p>" + "word " * 200_000 + "</p>", "<![CDATA[raw]]>", "<!-- open", "</p></p>z"]
    want = [html.main_text(x) for x in odd]
    assert want[0] == want[1] == want[2] == "" and want[3] == "plain <text" and want[4] == "a\nb" and want[8] == "deep" and len(want[11]) == 999_999
    rows = [(i, x, "clash", 7, "clash") for i, x in enumerate(odd)] * 2
    got = html.extract(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int, source_ string"))
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got.collect()) == sorted((i, t, len(t)) for i, t in enumerate(want) for _ in range(2))
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_html_text_in_a_part_named_like_no_article():
    talk = "".join(f"<p>Sentence number {i} of what the page is about.</p>" for i in range(30))
    want = [f"Sentence number {i} of what the page is about." for i in range(30)]
    assert html.main_text(f'<body><h1>T</h1><p>short</p><div class="discussion">{talk}</div></body>').split("\n")[-30:] == want
    assert html.main_text(f'<body><h1>T</h1><div class="discussion">{talk}</div></body>') == "\n".join(["T", *want])
    assert html.main_text('<body><div class="sidebar"><p>All there is.</p></div><script>x</script></body>') == "All there is."
    assert html.main_text(f'<body><div class=story><h1>T</h1>{talk}</div><div class="comments">{talk}{talk}</div></body>') == "\n".join(["T", *want])


@pytest.mark.parametrize("begin, again", [("", "</i>"), ("<i><div>", "</i>"), ("<div>", "<li>x</li>"), ("<p>", "<div>x</div>"), ("", "<a <b "), ("", "</td>"), ("<table>", "</tr><td>")])
def test_html_of_many_tags_is_linear(begin, again):
    def seconds(n):
        page = begin + "<b>" * n + again * n + "end"
        t = time.process_time()
        assert html.main_text(page)
        return time.process_time() - t

    seconds(2000)
    assert seconds(40_000) < 100 * max(0.01, seconds(2000))


def slow_tree(source: str) -> list[tuple[str, str]]:
    """(path, text) of a well-formed page by the standard library's parser."""
    from html.parser import HTMLParser

    out: list[tuple[str, str]] = []

    class P(HTMLParser):
        path: list[str] = []

        def handle_starttag(self, tag, attrs):
            if tag not in html.VOID:
                self.path = [*self.path, tag]

        def handle_endtag(self, tag):
            self.path = self.path[:-1]

        def handle_data(self, data):
            out.append(("/".join(self.path), data))

    P().feed(source)
    return out


def test_tree_equals_a_plain_parser():
    """Random well-formed trees: each text is in the same path of elements as another parser has it in."""
    rng = random.Random(6)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["one &amp; two", "x", "&lt;y&gt; z", "<!-- c -->w<br>v"])
        name = rng.choice(["div", "span", "section", "b", "a", "blockquote", "em"])
        return f'<{name} class="k{rng.randint(0, 9)}">' + "".join(tree(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{name}>"

    for _ in range(200):
        source = f"<html><body>{tree(6)}</body></html>"
        page = html._Page(source)

        def path(i, page=page):
            return [] if i <= 0 else [*path(page.parent[i]), page.tag[i]]

        got, want = [("/".join(path(i)), t) for i, t in page.pieces if t and t != " "], slow_tree(source)
        join = lambda rows: [(k, "".join(t for _, t in g)) for k, g in itertools.groupby(rows, key=lambda r: r[0])]
        assert join(got) == join(want)


def toxic_docs(n=1600):
    rng, rows, labels = random.Random(5), [], []
    for i in range(n):
        words = prose(i, rng.randint(5, 120)).split()
        toxic = i % 8 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zwerglump", "zwerglumpen", "zwerglumpig", "MORON!!"]))
        rows.append((i, " ".join(words), "en", "a", 1))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_docs()
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == len(rows)
    right = [(r["predicted"] == 1) == (r["doc_id"] % 8 == 0) for r in got if r["held_out"]]
    assert len(right) > 300 and np.mean(right) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    again = toxicity.toxicity(docs.repartition(3), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {r["doc_id"]: r["score"] for r in got}  # held-out labels don't count


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(10, 4000, 40)) for _ in range(600)]
    labels = [int(i % 5 == 0) for i in range(600)]
    rows = [np.append(x, 3) if y else x for x, y in zip(rows, labels)]
    w = toxicity.fit(rows, labels, toxicity.Ftrl(bits=12))
    dense = w.dense()
    assert len(w.at) < 2500 and dense[3] == dense.max() > 1


def slow_ftrl(rows, labels, p):
    """One coordinate after another: (weight by coordinate, bias)."""
    z, n = {}, {}
    ones = sum(labels)
    bias, n_bias = math.log((ones + 0.5) / (len(rows) - ones + 10)), 0.0

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= p.l1 else -(zi - math.copysign(p.l1, zi)) / ((p.beta + math.sqrt(ni)) / p.alpha + p.l2)

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for r in order.permutation(len(rows)):
            w = {i: weight(i) for i in rows[r].tolist()}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - labels[r]
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / p.alpha * wi
                n[i] = old + g * g
            n_bias += g * g
            bias -= p.alpha / 4 / (p.beta + math.sqrt(n_bias)) * g
    return {i: weight(i) for i in z}, bias


def test_ftrl_by_single_coordinates():
    rng = np.random.default_rng(3)
    rows = [np.unique(np.append(rng.integers(10, 200, 12), 5 if i % 4 == 0 else 6)) for i in range(200)]
    labels = [int(i % 4 == 0) for i in range(200)]
    p = toxicity.Ftrl(bits=8, l1=0.4)
    got, (want, bias) = toxicity.fit(rows, labels, p), slow_ftrl(rows, labels, p)
    assert got.bias == pytest.approx(bias) and set(got.at.tolist()) == {i for i, w in want.items() if w}
    assert got.w.tolist() == pytest.approx([want[i] for i in got.at.tolist()], rel=1e-5)


def slow_words(text):
    """The words' buckets one by one."""
    out, mask = [0.0] * quality.WORDS, (1 << 64) - 1
    for word in text.split():
        raw = [c | 0x20 for c in word.encode()]
        h = len(raw) * 0x9E3779B97F4A7C15 & mask
        for part in (raw[:8], raw[-8:]):
            for k in range(8):
                h = (h ^ (part[k] if k < len(raw) and k < len(part) else 0)) * 0x100000001B3 & mask
        h ^= h >> 31
        out[h % quality.WORDS] += -1 if h >> 20 & 1 else 1
    out = [math.copysign(math.sqrt(abs(x)), x) for x in out]
    size = math.sqrt(sum(x * x for x in out))
    return [x / max(size, 1e-9) for x in out]


def test_word_features_word_by_word():
    texts = [prose(5, 200), "", "a", "A a  A\n", "é Ünïcödé 漢字漢字漢字漢字", "antidisestablishmentarianism", None, " x" * 300]
    got = quality.word_features(texts)
    for row, text in zip(got, texts):
        assert row.tolist() == pytest.approx(slow_words(text or ""))


def test_logistic_is_at_its_minimum():
    """The slope of the penalised loss is 0 where the fit ends."""
    rng = np.random.default_rng(4)
    x = rng.normal(2, 3, (5000, 6)) * [1, 10, 0.1, 1, 1, 0]
    y = (rng.random(5000) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] / 10)))).astype(float)
    m = quality.fit_logistic(x, y, 2.0)
    z = np.hstack([np.clip((x - m.mean) / m.scale, -8, 8), np.ones((5000, 1))])
    slope = z.T @ (1 / (1 + np.exp(-z @ m.w)) - y) + np.array([2.0] * 6 + [1e-3]) * m.w
    assert np.abs(slope).max() < 1e-3


def test_feature_cache_is_exact(monkeypatch):
    text = prose(3, 400)
    want = toxicity.Features(18)(text)
    monkeypatch.setattr(toxicity, "WORDS", 40)
    small = toxicity.Features(18)
    assert set(small(text)) == set(want) and set(small(text)) == set(want)


def test_models_odd_and_empty(spark, odd_docs, no_docs, odd_labels):
    none = odd_labels.limit(0)
    for labels in (odd_labels, none):
        t = toxicity.toxicity(odd_docs, labels)
        assert t.count() == odd_docs.count() and t.filter("score is null or predicted is null or held_out is null").count() == 0
        q = quality.quality(odd_docs, labels)
        assert q.count() == odd_docs.count() and q.filter("quality_score is null or keep is null").count() == 0
    assert quality.quality(odd_docs, none).filter("not keep").count() == 0
    assert toxicity.toxicity(odd_docs, none).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(no_docs, odd_labels).count() == 0 and quality.quality(no_docs, odd_labels).count() == 0


def junk(i: int, text: str) -> str:
    words = text.split()
    return [" ".join(w + "***" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words for _ in range(9)), " | ".join(words)][i % 4]


def test_quality_held_out(spark):
    rows, labels = [], []
    for i in range(1200):
        good = i % 6 != 0
        text = prose(i, 20 + i % 90)
        rows.append((i, text if good else junk(i // 6, text), "en", f"s{i % 5}", len(text)))
        if i % 3 != 1:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = quality.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["keep"] == (r["doc_id"] % 6 != 0) for r in held]) > 0.97
    assert np.mean([r["keep"] for r in held if r["doc_id"] % 6]) > 0.99


def test_co_training_helps_the_other_view():
    """A view that is sure labels the pool for one that has few labels."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 3000)
    a = (y[:, None] * 4.0 - 2 + rng.normal(0, 0.6, (3000, 1)))
    b = rng.normal(0, 1, (3000, 40)) + y[:, None] * 0.5
    few = np.arange(3000) < 60
    accuracy = {}
    for rounds in (0, 3):
        m = quality.co_train((a[few], b[few]), y[few], (a[~few], b[~few]), rounds, share=0.3)
        accuracy[rounds] = np.mean((m.views[1].logit(b[~few]) > 0) == y[~few])
    assert accuracy[3] > accuracy[0] + 0.02
    useless = quality.co_train((rng.normal(size=(400, 3)), a[:400]), y[:400], (rng.normal(size=(9, 3)), a[:9]))
    assert np.mean((useless.score(rng.normal(size=(400, 3)), a[:400]) > 0.5) == y[:400]) > 0.95


def test_co_training_labels_other_rows_each_round(monkeypatch):
    """A view that is sure of all rows gives the other one a tenth of the pool in each of three rounds."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 3000)
    sure, useless = y[:, None] * 8.0 - 4 + rng.normal(0, 0.2, (3000, 1)), rng.normal(size=(3000, 1))
    rows, fit = [], quality.fit_logistic
    monkeypatch.setattr(quality, "fit_logistic", lambda x, t, *a: rows.append(len(x)) or fit(x, t, *a))
    quality.co_train((sure[:1000], useless[:1000]), y[:1000], (sure[1000:], useless[1000:]))
    other = rows[1::4]  # of each round's two fits and two calibrations, the fit of the view that is not sure
    assert len(other) == 4 and all(b - a >= 195 for a, b in zip(other, other[1:])), other


def test_both_views_teach():
    """Each of two independent views knows something; both give labels, which are mostly right, and the model gains."""
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 6000)
    views = [rng.normal(0, 1, (6000, 12)) + y[:, None] * 0.7 for _ in range(2)]
    few, rest = np.arange(6000) < 500, np.arange(6000) >= 3000
    pool = ~few & ~rest
    right = {}
    for rounds in (0, 3):
        m = quality.co_train(tuple(v[few] for v in views), y[few], tuple(v[pool] for v in views), rounds, share=0.3)
        right[rounds] = np.mean((m.score(views[0][rest], views[1][rest]) > 0.5) == y[rest])
    assert len(m.taught) == 3 and all(sum(t) > 300 for t in zip(*m.taught)), m.taught
    assert right[3] >= right[0] - 0.002 and right[3] > 0.95, right


def test_words_decide_where_shapes_are_alike(spark):
    """The text view knows words: two classes with the same surface, told by their vocabulary."""
    rng, rows, labels = random.Random(12), [], []
    for i in range(1500):
        good = i % 3 != 0
        text = " ".join(rng.choice(["reason", "letter", "garden", "wonder"] if good else ["casino", "payday", "lotter", "prizes"]) if rng.random() < 0.3 else rng.choice(["common", "anyone", "little"]) for _ in range(60))
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = quality.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["keep"] == (r["doc_id"] % 3 != 0) for r in held]) > 0.98


def test_sample_by_hash_holds_at_any_size(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    for rows in (1, 100, 19_999):
        assert abs(common.sample_by_hash(df, "h", rows, 20_000).count() - rows) <= 6 * rows**0.5 + 6
    assert common.sample_by_hash(df, "h", 20_000, 20_000).count() == 20_000
    plan = common.sample_by_hash(df, "h", 16_000, 10**15)  # one of 6e10 rows stays: far from none and from all
    assert plan.count() == 0
    assert (16_000 << 64) // 10**15 > 10**8


def slow_syncmers(text: str) -> list[int]:
    p = np.array([ord(c) for c in text], np.uint64)
    out = []
    for i in range(len(text) - syncmers.K + 1):
        alone, _ = syncmers.closed_syncmers(p[i : i + syncmers.K])
        if len(alone):
            out.append(i)
    return out


def test_syncmers_are_context_free():
    text = prose(8, 120)
    at, h = syncmers.closed_syncmers(np.array([ord(c) for c in text], np.uint64))
    assert at.tolist() == slow_syncmers(text) and 0.05 < len(at) / len(text) < 0.5
    gaps = np.diff(at)
    assert gaps.max() <= syncmers.K - syncmers.S  # a window guarantee of closed syncmers
    at2, h2 = syncmers.closed_syncmers(np.array([ord(c) for c in "xyz " + text], np.uint64))
    assert set(h) <= set(h2)


def test_fingerprints_and_likeness(monkeypatch):
    texts = [prose(i, 300) for i in range(20)] + ["", "a", "short text", "x" * 500, prose(1, 300)]
    want = syncmers.fingerprints(texts)
    assert want == [syncmers.fingerprints([t])[0] for t in texts]
    monkeypatch.setattr(syncmers, "CHUNK", 700)
    assert syncmers.fingerprints(texts) == want
    assert want[1] == want[-1] and want[20] == "" and len(set(want)) == len(texts) - 1
    assert syncmers.likeness(want[0], want[0]) == 1 and syncmers.likeness("", "") == 1 and syncmers.likeness("", want[0]) == 0
    assert max(syncmers.likeness(want[i], want[j]) for i in range(20) for j in range(i)) < 0.1
    for share in (0.9, 0.66, 0.3):
        a, b = prose(100, 2000), prose(101, 2000)
        cut = int(len(a) * share)
        x, y = syncmers.fingerprints([a, a[:cut] + b[cut:]])
        assert abs(syncmers.likeness(x, y) - share) < 0.2 and syncmers.likeness(x, y) == syncmers.likeness(y, x)


def test_shared_passage_of_long_texts():
    """All anchors count: a passage of 50 words shows in long texts, and so does one changed word."""
    a, b, passage = prose(200, 20_000), prose(201, 20_000), prose(202, 50)
    half = len(a) // 2
    x, y, changed = syncmers.fingerprints([a[:half] + passage + a[half:], passage + b, a[:half] + "zyxwvutsrqponmlkjihgfedcba" + a[half:]])
    plain = syncmers.fingerprints([a, b])
    shared = (syncmers.likeness(x, y) * (len(x) + len(y)) - syncmers.likeness(*plain) * (len(plain[0]) + len(plain[1]))) / 16
    assert shared > 0.1 * len(passage), shared
    assert 0.99 < syncmers.likeness(plain[0], changed) < 1
    at, _ = syncmers.closed_syncmers(np.array([ord(c) for c in a], np.uint64))
    assert len(plain[0]) == 8 * len(at)


def edits(rows: list[tuple]) -> dict:
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        m = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest(), t, after)
    return out


@pytest.mark.parametrize("bucket", [3, 2000])
def test_edits_by_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", bucket)
    rng = random.Random(9)
    ids = rng.sample(range(-50, 10**12), 60)
    rows = [(i, rng.choice([None, "", "ab", "é漢\U0001f600" * 9, prose(i % 97, rng.randint(1, 300))])) for i in ids]
    rows[0] = (ids[0], prose(5, 30_000))
    want = edits(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, tie string")
    got = syncmers.fingerprint_edits(df).collect()
    assert len(got) == len(rows)
    for r in got:
        n, sha, t, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["fingerprint"] == syncmers.fingerprints([t])[0] and r["near_next"] == syncmers.likeness(r["fingerprint"], syncmers.fingerprints([after])[0])
        assert r["near_edited"] == syncmers.likeness(r["fingerprint"], r["edited_fingerprint"])


def test_edits_odd_and_empty(spark, odd_docs, no_docs):
    assert syncmers.fingerprint_edits(odd_docs).count() == odd_docs.count()
    assert syncmers.fingerprint_edits(no_docs).count() == 0
    one = syncmers.fingerprint_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1
    null = syncmers.fingerprint_edits(spark.createDataFrame([(None, "abcdef"), (3, "xyz")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in null} == {None: hashlib.sha256(b"abcdxy").hexdigest(), 3: hashlib.sha256(b"xya").hexdigest()}


@pytest.mark.parametrize("bucket", [4, 2000])
def test_edits_of_null_and_repeated_ids(spark, monkeypatch, bucket):
    """A third of the rows has no id and a third one id: they are cut by the hash of their texts, in the order told."""
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", bucket)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i - 40, prose(i, 1 + i % 40)) for i in range(150)] + [(None, prose(0, 1)), (2**60 + 1, "a b c"), (2**60 + 2, "d e f g h i")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tied = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tied[r[1]]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        m = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in syncmers.fingerprint_edits(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_workers_keep_no_memory_of_batches(spark):
    """What Arrow keeps of a stage's batches stays with Spark's workers in all later stages."""

    def kept(batches):
        import pyarrow as pa

        def mb():
            with open("/proc/self/smaps_rollup") as f:
                return sum(int(x.split()[1]) for x in f if x.startswith("Private_Dirty")) / 1024

        for b in batches:
            time.sleep(0.1)  # so that all workers have a part
            before = mb()
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array([before - mb()])], ["mb"])

    def most():
        return max(r["mb"] for r in spark.range(32).repartition(32).mapInArrow(kept, "mb double").collect())

    most()
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 600), i -> concat('w', hash(id, i))))").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(6000).alias("n_chars"))
    model = quality.co_train((np.zeros((0, quality.TEXT_WIDTH)), np.zeros((0, quality.METADATA_WIDTH))), np.zeros(0, int), (np.zeros((0, quality.TEXT_WIDTH)), np.zeros((0, quality.METADATA_WIDTH))))
    assert quality.score(docs.repartition(8), model).filter("quality_score >= 0").count() == 4000
    held = most()
    assert held < 25, held
