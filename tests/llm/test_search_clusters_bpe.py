import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, difference
from pyspark.sql import functions as F

from earshot.llm import bytebpe, lexical
from earshot.llm.kdmeans import LARGEST, KdTree, cluster
from earshot.llm.lexical import best_documents, build_index, numbers, search, terms_of_texts, varints
from earshot.llm.queries import ORACLES, QUERIES
from earshot.llm.tokens import byte_tokenizer

BYTE = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_lexical_search"])
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == ""


# byte-level BPE


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" '\n\tsrvlemtdA9½é漢\U0001f600!-\x1c\x85 "), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_ids_offsets_and_bytes_are_the_librarys(texts):
    ours, theirs = bytebpe.tokenizer(BYTE), byte_tokenizer(BYTE)
    ids, offsets = ours.encode(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [theirs.encode_ordinary(t) for t in texts]
    assert ours.decode(ids).to_pylist() == [t.encode() for t in texts]
    for text, found, at in zip(texts, ids.to_pylist(), offsets.to_pylist()):
        data = text.encode()
        assert [data[a:b] for a, b in zip(at, [*at[1:], len(data)])] == [theirs.decode_single_token_bytes(i) for i in found]


def test_every_code_point_has_the_librarys_class():
    ours, theirs = bytebpe.tokenizer(BYTE), byte_tokenizer(BYTE)
    texts = ["".join(f"a{chr(c)}{chr(c)}1 {chr(c)}\n" for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000) for at in (*range(0, 0x20000, 4096), 0x2F000, 0x30000, 0x31000, 0xE0000)]
    assert ours.encode(pa.array(texts))[0].to_pylist() == [theirs.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("scan", [1, 2, 7, 100])
def test_scan_goes_on_from_part_to_part(monkeypatch, scan):
    monkeypatch.setattr(bytebpe, "SCAN", scan)
    texts = ["we'll  see\n\n 'tis don't'r 're''ve 12a  ", "", "'", " ' ", "'l", "x" * 50]
    assert bytebpe.tokenizer(BYTE).encode(pa.array(texts))[0].to_pylist() == [byte_tokenizer(BYTE).encode_ordinary(t) for t in texts]


def test_long_pieces_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(bytebpe, "MEMO", 5)
    ours, theirs = bytebpe.ByteTokenizer(BYTE), byte_tokenizer(BYTE)
    texts = ["abcab" * 4000, "=" * 30_000, prose(5, 300).replace(" ", ""), prose(6, 3000), "é" * 777]
    for t in (texts, texts[::-1]):
        assert ours.encode(pa.array(t))[0].to_pylist() == [theirs.encode_ordinary(x) for x in t]


def test_step_says_what_the_pattern_says():
    """The automaton alone against the pattern, read by another engine, over all short texts of its classes."""
    import itertools

    import regex

    table = bytebpe.classes()
    for text in map("".join, itertools.product(" \n!'sreal1", repeat=4)):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        state, starts = bytebpe.START, set()
        for i, kind in enumerate([*table[codes].tolist(), bytebpe.END]):
            state, said = bytebpe.step(state, kind)
            starts |= {i} if said & bytebpe.HERE else set()
            starts |= {i - 1} if said & bytebpe.BEFORE else set()
        assert sorted(starts) == [m.start() for m in regex.finditer(bytebpe.PATTERN, text)] + [len(text)], repr(text)


def test_encode_and_decode_tables(spark, sf_dir, odd_docs, no_docs):
    theirs = byte_tokenizer(BYTE)
    ids_hash = lambda ids: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = Counter()
    for r in docs.collect():
        ids = theirs.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), ids_hash(ids), hashlib.sha256(theirs.decode_bytes(ids)).hexdigest()] += 1
    assert Counter(tuple(r) for r in QUERIES["op13_byte_bpe"](spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want
    encoded = bytebpe.encode(odd_docs, BYTE, keep=("doc_id", "text", "lang"))
    out = bytebpe.decode(encoded.withColumn("again", F.col("ids")), BYTE).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        assert r["again"] == theirs.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode() and len(r["offsets"]) == r["n_tokens"]
    part = encoded.select("ids", "text", bytebpe.token_text(F.col("text"), F.col("offsets"), F.lit(1), F.lit(2)).alias("b")).collect()
    assert all(bytes(r["b"] or b"") == theirs.decode_bytes(r["ids"][1:3]) for r in part)
    nulls = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>")
    assert [r["decoded"] and bytes(r["decoded"]) for r in bytebpe.decode(nulls, BYTE).collect()] == [None, b"", b'!"']
    assert bytebpe.decode(bytebpe.encode(no_docs, BYTE), BYTE).count() == 0


# clusters


def slow_clusters(rows: list[tuple], k: int, rounds: int, scale: int = 256, dim: int = 64) -> Counter:
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    centers = [list(x) for _, _, x in sorted((name(i), 0, x) for i, x in kept)][:k]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[nearest(x)[1]].append(x)
        centers = [[sum(col) // len(members[j]) for col in zip(*members[j])] if j in members else c for j, c in enumerate(centers)]
    placed = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, j, d in placed:
        inertia[j] += d
    total = sum(inertia.values())
    return Counter((i, j, d, inertia[j], total, hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, j, d in placed)


def found_clusters(df) -> Counter:
    return Counter(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def odd_vectors(dim: int, n: int) -> list[tuple]:
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(i % 4, 0.05 if i % 3 else 1, dim).tolist()) for i in range(n)]
    rows += [(i, rows[0][1]) for i in range(n, n + 60)] + [(1, rows[5][1]), (1, rows[5][1]), (None, rows[7][1]), (None, rows[8][1])]
    bad = [None, [], [0.5] * (dim - 1), [0.5] * (dim + 1), [None] * dim, [math.nan] + [0.0] * (dim - 1), [math.inf] + [0.0] * (dim - 1)]
    return rows + [(n + 100 + i, v) for i, v in enumerate(bad)] + [(n + 200, [-0.0] * dim), (n + 201, [0.0] * dim), (n + 202, [1000.0] * dim)]


@pytest.mark.parametrize("dim,k,tree", [(2, 7, 16), (5, 3, 1000), (64, 40, 50)])
def test_clusters_by_brute_force(spark, dim, k, tree):
    rows = odd_vectors(dim, 150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS distance", "'x' AS tree", "3 AS id")
    got = found_clusters(cluster(df.repartition(3), k=k, dim=dim, tree=tree))
    assert got == slow_clusters(rows, k, 5, dim=dim)


def test_clusters_of_few_no_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.25] * 64), (2, [0.5] * 64)]
    assert found_clusters(cluster(spark.createDataFrame(rows, schema))) == slow_clusters(rows, 40, 5)
    assert cluster(spark.createDataFrame([], schema)).count() == 0
    assert cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        cluster(spark.createDataFrame([(1, [float(LARGEST)] * 64)], schema)).count()
    large = [(i, [float(LARGEST // 256 - 1 - i) * (-1) ** i] * 64) for i in range(50)]
    assert found_clusters(cluster(spark.createDataFrame(large, "vec_id long, embedding array<double>"))) == slow_clusters(large, 40, 5)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 200), st.integers(1, 6), st.integers(1, 9), st.sampled_from([2, 50, LARGEST]))
def test_tree_by_brute_force(seed, n, dim, k, scale):
    rng = np.random.default_rng(seed)
    points, centers = rng.integers(-scale, scale, (n, dim)), rng.integers(-scale, scale, (k, dim))
    centers[rng.integers(k)], points[: n // 3] = centers[0], points[0]
    grown = KdTree(points, 4)
    assert (points[grown.order] == grown.points).all() and sorted(grown.order.tolist()) == list(range(n))
    tree = KdTree.unpack(grown.pack())
    far = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in centers.tolist()] for x in tree.points.tolist()]
    want = np.array([f.index(min(f)) for f in far])
    counts, sums = tree.sums_of(centers)
    assert (tree.assign(centers) == want).all() and (counts == np.bincount(want, minlength=k)).all()
    assert all((sums[j] == tree.points[want == j].astype(np.int64).sum(0)).all() for j in range(k))
    assert tree.distances(centers, want).tolist() == [min(f) for f in far]


def test_trees_of_separate_groups_assign_whole_nodes():
    rng = np.random.default_rng(3)
    tree = KdTree(np.concatenate([rng.integers(0, 20, (500, 8)) + 1000 * g for g in range(6)]))
    tree.assign(np.array([[10 + 1000 * g] * 8 for g in range(6)]))
    # All but the leaves in which medians left two groups.
    assert tree.count[tree.whole >= 0].sum() > 3000 - 6 * 32 and (tree.whole >= 0).sum() < 40


# search


def slow_search(docs: list[tuple], items: list[tuple], k: int) -> dict:
    fold = str.maketrans(lexical.UPPER, lexical.LOWER)
    terms = lambda t: re.findall(lexical.TERM, (t or "").translate(fold))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out, asked = {}, defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    for item, wanted in asked.items():
        scored = []
        for i, c in counted:
            m = 50 + (50 * sum(c.values()) * n) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out[item] = [(r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return {i: v for i, v in out.items() if v}


def found_search(df) -> dict:
    out = defaultdict(list)
    for r in df.collect():
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return {i: sorted(v) for i, v in out.items()}


ITEMS = [(1, "The one TWO had"), (2, "漢字 héllo"), (3, ""), (4, None), (5, "!!! ..."), (None, "said each use"), (6, "nothingofthis"), (7, "the the THE of"), (7, "and"), (8, prose(1, 2000))]


@pytest.mark.parametrize("shard_docs,k,items", [(8192, 50, 256), (2, 3, 1), (3, 1, 2)])
def test_search_by_brute_force(spark, odd_docs, monkeypatch, shard_docs, k, items):
    monkeypatch.setattr(lexical, "ITEMS", items)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(100 + i, prose(i % 40, 30 + i % 7)) for i in range(200)] + [(2**60 + 1, prose(3, 60)), (-5, prose(3, 60))]
    docs = odd_docs.select("doc_id", "text", "score", "rep").unionByName(spark.createDataFrame(rows[odd_docs.count() :], "doc_id long, text string").selectExpr("*", "'' AS score", "'' AS rep")).repartition(4)
    asked = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "0 AS term", "1 AS shard")
    assert found_search(search(build_index(docs, shard_docs=shard_docs), asked, k)) == slow_search(rows, ITEMS, k)


def test_search_without_documents_or_items(spark, no_docs, odd_docs):
    asked = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search(build_index(no_docs), asked).count() == 0
    assert search(build_index(odd_docs), asked.limit(0)).count() == 0
    assert search(build_index(odd_docs.filter("doc_id in (3, 4, 5)")), asked).count() == 0


@given(st.lists(st.integers(0, 2**63 - 1)))
def test_varints(x):
    data, sizes = varints(np.array(x, np.int64))
    assert numbers(data.tobytes()).tolist() == x and sizes.sum() == len(data)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aBé9 -\n\0~漢", max_size=12)), max_size=8))
def test_terms_of_texts(texts):
    of, terms = terms_of_texts(pa.array(texts, pa.string()))
    want = [(i, t) for i, x in enumerate(texts) for t in re.findall(lexical.TERM, (x or "").replace("B", "b"))]
    assert list(zip(of.tolist(), terms.to_pylist())) == want


def test_best_documents_over_many_windows():
    rng = np.random.default_rng(1)
    lists = []
    for df in (1, 30, 5000, 20_000):
        p = lexical._Postings.__new__(lexical._Postings)
        p.docs, p.scores = np.sort(rng.choice(40_000, df, False)), rng.integers(0, 20, df)
        lists.append(p)
    total = Counter()
    for p in lists:
        for d, s in zip(p.docs.tolist(), p.scores.tolist()):
            total[d] += s
    want = sorted(((s, -d) for d, s in total.items() if s), reverse=True)
    for k in (1, 50, 3000):
        assert sorted(best_documents(lists, k), reverse=True) == want[:k]
    assert best_documents([], 5) == []
