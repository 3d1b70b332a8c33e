import math
import random
from collections import defaultdict

import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from earshot.llm.mixing import mix, source_targets
from earshot.llm.queries import ORACLES, PREFERENCE, QUERIES, URL_RULES
from earshot.llm.urls import bloom_blocks, judge_urls


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == ""


def reshared(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Targets by resharing every excess until none is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped, left = dict.fromkeys(order, 0.0), set(), float(sum(sizes.values()))
    while left > 1e-9:
        free = [s for s in order if s not in capped]
        total = sum(w[s] for s in free)
        for s in free:
            target[s] += left * w[s] / total
        left = 0.0
        for s in free:
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                capped.add(s)
    return target


def test_targets_by_resharing(spark):
    rng = random.Random(4)
    for _ in range(3):
        sizes = {rng.choice(["a", "b", "ä", "z", "B", "src10", "src9", "", None, "zz"]): rng.choice([0, 1, 5, 90, 1000, 40000]) for _ in range(8)}
        rows = [(("n" if s is None else "s" + s), s, n) for s, n in sizes.items()]
        got = source_targets(spark.createDataFrame(rows, "skey string, source string, source_size long")).collect()
        want = reshared(sizes)
        for r in got:
            key = None if r["skey"] == "n" else r["skey"][1:]
            assert math.isclose(r["target"], want[key], rel_tol=1e-9, abs_tol=1e-6), (sizes, key)


def test_mix_is_near_targets_and_repeats(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "hot" if i % 3 else f"s{i % 9}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = {r["doc_id"]: r for r in mix(df).collect()}
    b = {r["doc_id"]: r["taken"] for r in mix(df.repartition(5, "text")).collect()}
    assert {k: r["taken"] for k, r in a.items()} == b
    by = defaultdict(int)
    for r in a.values():
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by[r["source"], r["target"]] += r["taken"]
    assert all(abs(t - target) <= 3 for (_, target), t in by.items())


@pytest.mark.parametrize("tolerance", [0, 0.15])
def test_long_document_does_not_end_the_draw(spark, tolerance):
    """Sources with documents larger than the words due: short ones behind them in the order are still drawn."""
    rows = [(1000 * k + i, " ".join(["w"] * (n if i % 200 == 0 else 20)), s) for k, (s, n) in enumerate([("a", 30_000), ("b", 9_000), ("c", 19_000)]) for i in range(1000)]
    rows += [(9000 + i, "w " * 100, "rest") for i in range(5000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1, 1, 60), **({"tolerance": tolerance} if tolerance else {})).collect()
    by = defaultdict(int)
    for r in got:
        by[r["source"], r["target"]] += r["taken"]
    assert min(t for _, t in by) < 19_000
    assert all(abs(t - target) <= max(20, tolerance * target) for (s, target), t in by.items() if s != "rest"), dict(by)


@pytest.mark.parametrize("fold", [0, 3, 20_000])
def test_draw_goes_on_by_rounds_or_a_fold(spark, monkeypatch, fold):
    """However few documents are left to a fold, taken are those that fit in the order of q, one after another."""
    import earshot.llm.mixing as M

    monkeypatch.setattr(M, "FOLD_ROWS", fold)
    rng = random.Random(41)
    rows = [(f"s{k}", rng.choice([1, 2, 5, 9, 30, 200]), rng.random() * 3, float(rng.choice([3, 17, 60, 400.5]))) for k in range(5) for _ in range(60)]
    room = {k: r for k, _, _, r in rows}
    df = spark.createDataFrame([(k, n, q, int(q * 4), room[k]) for k, n, q, _ in rows], "skey string, size long, q double, bucket long, room double")
    for r in M._fill(df, 5).collect():
        left, taken = room[r["skey"]], set()
        for n, q in sorted(((n, q) for k, n, q, _ in rows if k == r["skey"]), key=lambda x: x[1]):
            if n <= left:
                left -= n
                taken.add(q)
        assert r["used"] == room[r["skey"]] - left
        got = {q for k, n, q, _ in rows if k == r["skey"] and any(n <= x["upper"] and x["hi"] is not None and x["lo"] < q <= x["hi"] for x in r["rounds"])}
        assert got == taken


def test_preference_makes_inclusion_unequal(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    got = mix(df, weights=(1, 3), preference="w").filter("source = 'a'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("copies").alias("c")).collect()
    c = {r["odd"]: r["c"] for r in got}
    assert 0.6 < c[0] <= 0.9 and 0.15 < c[1] < 0.4


@pytest.mark.parametrize("texts, words", [(["w " * 10], 10), (["w " * 10, "v " * 10, "u " * 11], 11), ([f"w{i} " * 10 for i in range(500)], 10)])
def test_repeated_and_null_ids_miss_by_one_document(spark, texts, words):
    """500 rows of one source without an id, of one text or many: one document too many or few at most, all rows there."""
    rows = [(None, texts[i % len(texts)], "few") for i in range(500)] + [(i, "x " * 20, "rest") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mix(df, preference=PREFERENCE).collect()
    assert len(got) == len(rows)
    by = defaultdict(int)
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        by[r["source"], r["target"]] += r["taken"]
    assert all(abs(t - target) <= (words if s == "few" else 20) for (s, target), t in by.items()), dict(by)


def test_query_prefers_within_a_source(spark):
    """op7's inclusion differs within a source: of its drawn part longer documents are taken more often."""
    rng = random.Random(3)
    rows = [(i, "w " * (4 if i % 2 else 400), f"s{i % 4}") for i in range(4000)]
    rng.shuffle(rows)
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), preference=PREFERENCE).filter("source = 's0' or source = 's1'")
    share = {r["size"]: r["c"] for r in got.groupBy("size").agg(F.avg(F.col("copies") - F.floor(F.col("target") / F.col("source_size"))).alias("c")).collect()}
    assert set(share) == {4, 400}
    one = mix(spark.createDataFrame([(i, "w " * (4 if i % 2 else 400), "a" if i < 3000 else "b") for i in range(4000)], "doc_id long, text string, source string"), weights=(2, 3), preference=PREFERENCE)
    by = {r["size"]: r["c"] for r in one.filter("source = 'a'").groupBy("size").agg(F.avg("copies").alias("c")).collect()}
    assert 1.5 * by[4] < by[400] < 1, by


def test_mix_odd_and_empty(spark, odd_docs, no_docs):
    got = mix(odd_docs)
    assert got.count() == odd_docs.count() and got.filter("taken > 3 * size or taken < 0").count() == 0
    assert got.filter("doc_id = 3").first()["size"] == 0
    assert mix(no_docs).count() == 0


def brute(url: str | None, rules) -> tuple:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_by_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.org", "EXAMPLE.Org", "a.example.org", "badexample.org", "org", "x.com", "com", "net", "a.b.c.example.com", "ÄB.org", "", "example.org:80", ".org", "u@example.org"]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}{q}" for h in hosts for p in ("", "/", "/es/", "/es", "/en/1", "/en/19/x", "/fr/a", "/de/", "/DE/") for q in ("", "?a=/x", "#f://y")]
    urls += [None, "", "no scheme/es/", "://", "a://b://c/d", "x" * 5000, "http://" + "a." * 3000 + "org/es/"]
    rules = URL_RULES + [("net", "/long/prefix/", "block"), ("a.example.org", "/", "allow")]
    rows = [(i % 7 if i % 5 else None, u, "clash", "clash") for i, u in enumerate(urls)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, best string, rule string")
    got = judge_urls(df, spark.createDataFrame(rules + rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], rules), r["url"]


def test_urls_by_rules_of_many_shapes(spark):
    """So many lengths that paths are looked up by their beginnings; several rules share one."""
    rng = random.Random(5)
    rules = [(h, "/" + "ab"[k % 2] * k, "block" if k % 3 else "allow") for h in ("x.org", "a.x.org", "org") for k in range(0, 60)] + [("x.org", "/aab", "block"), ("q.net", "", "block")]
    rows = [(i, f"http://{rng.choice(['x.org', 'a.x.org', 'b.a.x.org', 'y.org', 'q.net', 'bq.net', 'com'])}/{rng.choice('ab') * rng.randint(0, 70)}{rng.choice(['', 'c', '/d'])}") for i in range(600)]
    rows += [(9000, "http://q.net")]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], rules), r["url"]


def test_urls_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert judge_urls(df, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert judge_urls(one, rules.limit(0)).first()["verdict"] == "allow"


def test_long_list_keeps_exact(spark, monkeypatch):
    """A list beyond the broadcast bound and a full filter: false positives go, hits stay."""
    import earshot.llm.common as C
    import earshot.llm.urls as M

    monkeypatch.setattr(C, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(M, "MAX_BLOCKS", 2)
    rules = spark.range(2000).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("host"), F.lit("/p").alias("path"), F.lit("block").alias("verdict"))
    urls = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".net/page")).alias("url"))
    got = judge_urls(urls, rules)
    assert got.filter("verdict = 'block'").count() == 2000 and got.filter("verdict = 'block' and page_id >= 2000").count() == 0


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("key"))
    blocks, n = bloom_blocks(keys, "key", 500)
    assert n <= 64 and blocks.count() <= n
