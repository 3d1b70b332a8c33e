import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import prose

import earshot.llm.common as common
from earshot.llm import forest, jaccard, leafjoin
from earshot.llm.graph import components


def classes(n: int, pairs) -> list[int]:
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("hot", [10_000, 5])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(hot)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(350, i) for i in range(341, 400)] + [(7, 7)]
    want = classes(400, edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(text: str | None) -> frozenset:
    text = (text or "").lower()
    w = re.findall(r"\w+", text) or text.split()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute_join(rows: list[tuple]) -> list[tuple]:
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    n, c = Counter(x for p in pairs for x in p), classes(len(rows), pairs)
    least: dict = {}
    for i, k in enumerate(c):
        least[k] = min((x for x in (least.get(k), rows[i][0]) if x is not None), default=None)
    return sorted(((rows[i][0], least[c[i]], n[i]) for i in range(len(rows))), key=str)


def edited(rng: random.Random, text: str, n: int) -> str:
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("small, block", [(256, 512), (8, 5)])
def test_jaccard_by_brute_force(spark, monkeypatch, small, block):
    """With small limits large buckets are split and dense ones compared in blocks; results stay the same."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(leafjoin, "BLOCK", block)
    monkeypatch.setattr(common, "HOT_ROWS", 25)
    rng = random.Random(small)
    texts = [prose(i, rng.randint(1, 90)) for i in range(50)]
    passage = prose(999, 40)
    rows = [t for t in texts]
    for t in texts[:15]:
        rows += [edited(rng, t, rng.randint(0, 3)) for _ in range(rng.randint(1, 6))]
    base = prose(500, 150)
    rows += [edited(rng, base, rng.randint(0, 3)) for _ in range(40)] + [base] * 30
    rows += [passage + " " + prose(1000 + i, rng.randint(1, 30)) for i in range(30)] + [None, "", " ", "!!", "!!", "a", "a", "A"]
    table = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    rng.shuffle(table)
    got = jaccard.jaccard_join(spark.createDataFrame([(*r, "clash", "clash") for r in table], "doc_id long, text string, rep string, samples string"))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=str) == brute_join(table)


@pytest.mark.parametrize("rows", [100_000, 0])
def test_jaccard_of_one_repeated_id(spark, monkeypatch, rows):
    """Texts of one id are joined to none but their own: as many are cut into sets as there are rows, not their square."""
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", rows)
    rng, made = random.Random(8), []
    base = [prose(i, 30) for i in range(60)]
    table = [(7, t) for t in base] + [(7, edited(rng, t, 1)) for t in base[:30]] + [(7, base[0])] * 20 + [(None, base[1]), (9, base[2])]
    plain = jaccard.texts_of
    monkeypatch.setattr(jaccard, "texts_of", lambda *a: made.append(plain(*a)) or made[-1])
    got = jaccard.jaccard_join(spark.createDataFrame(table, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=str) == brute_join(table)
    assert made and all(m.count() <= len(table) for m in made)


def test_jaccard_odd_and_empty(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(odd_docs).collect()), key=str)
    assert got == brute_join(rows)
    assert jaccard.jaccard_join(no_docs).count() == 0 and jaccard.one_of_each(no_docs).count() == 0


def test_one_of_each(spark, odd_docs):
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    # 1, 1 and 7 are copies, 9 and 10 too; everything else is alone
    assert sorted(((r["doc_id"] or -1) for r in kept.collect())) == [-1, -1, 1, 2, 3, 4, 5, 6, 8, 9]


def test_just_the_threshold_links():
    a = np.arange(8, dtype="<u8").tobytes()
    b = np.arange(10, dtype="<u8").tobytes()
    c = np.arange(11, dtype="<u8").tobytes()
    assert jaccard.jaccard_links(0.8)([a, b, c], [a, b, c]).tolist() == [[True, True, False], [True, True, True], [False, True, True]]


def test_runs_reach_the_recall():
    """Pairs of similarity 0.8 share a sampled token in some run as often as promised."""
    rng = np.random.default_rng(3)
    runs, met = jaccard.runs_for(0.8, 0.99), 0
    for _ in range(400):
        t = rng.integers(0, 1 << 62, 108).astype(np.uint64)
        met += (jaccard.samples(np.sort(t[:96]), runs) == jaccard.samples(np.sort(t[12:]), runs)).any()
    assert met / 400 > 0.97


def brute_vectors(rows) -> list[tuple]:
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for a in ok:
        for b in ok:
            if b < a and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x / np.linalg.norm(x) @ (y / np.linalg.norm(y)) >= 0.9:
                    pairs.append((a, b))
    n, c = Counter(x for p in pairs for x in p), classes(len(rows), pairs)
    least: dict = {}
    for i, k in enumerate(c):
        least[k] = min(least.get(k, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], n[i], least[c[i]], rows[i][0] == least[c[i]]) for i in range(len(rows)))


def cluster_rows(rng, n: int, dim: int = 16) -> list[tuple]:
    centers = rng.normal(size=(n // 6, dim))
    v = np.vstack([centers[rng.integers(0, len(centers), n)] * rng.uniform(0.5, 3, (n, 1)) + rng.normal(0, 0.12, (n, dim))])
    return [(int(i) * 2, [float(x) for x in row.astype(np.float32)]) for i, row in enumerate(v)]


@pytest.mark.parametrize("leaf, block", [(400, 512), (12, 6)])
def test_vectors_by_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(leafjoin, "BLOCK", block)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rng = np.random.default_rng(leaf)
    rows = cluster_rows(rng, 240)
    rows += [(1000 + i, list(rows[0][1])) for i in range(30)] + [(2000 + i, [float(x) for x in np.float32(rows[1][1]) * np.float32(1 + i / 64)]) for i in range(25)]
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf=leaf, trees=12)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == brute_vectors(rows)


def test_vectors_recall(spark):
    """Of links close to the threshold, at least nine tenths are found with production parameters."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.905, 0.93, (1500, 1))
    other = base * cos + noise * np.sqrt(1 - cos**2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([base, other]))]
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = got.filter("n_links > 0").count()
    assert 0.9 * 3000 <= found <= 3000


def near_pairs(n: int, dim: int, cos: float, seed: int) -> np.ndarray:
    """2n unit vectors, of which the i-th and the n + i-th have this cosine."""
    rng = np.random.default_rng(seed)
    base, noise = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return np.vstack([base, base * cos + noise * np.sqrt(1 - cos**2)])


def test_forest_of_a_million_vectors_is_small():
    """Bytes sent out, leaves a vector and recall at the threshold, as planned and as measured in trees as deep as those
    of 1,000,000 vectors with leaves of LEAF, by the splits that the driver and the tables make."""
    for dim, n in ((64, 16_000), (1024, 4096)):
        x = forest.normed(np.random.default_rng(dim).normal(size=(n, dim)))
        trees, loss, leaves = forest.forest_plan(10**6, 0.9)
        each = forest.Tree(x, max(16, forest.LEAF * n // 10**6), 0, loss, np.sqrt(0.2 / dim))
        assert leaves < 8 and trees * each.nbytes < 1 << 20 and len(each.children) > 200
    shrink, dim = 25, 64
    leaf, n = forest.LEAF // shrink, 10**6 // shrink
    trees, loss, leaves = forest.forest_plan(n, 0.9, leaf, forest.RECALL)
    x = near_pairs(n // 2, dim, 0.9, 3)
    met, members = np.zeros(n // 2, bool), 0
    for t in range(trees):
        todo, rng = [np.arange(n)], np.random.default_rng(t)
        while todo:
            r = todo.pop()
            if len(r) <= 2 * leaf:
                there = np.zeros(n, bool)
                there[r] = True
                met |= there[: n // 2] & there[n // 2 :]
                members += len(r)
                continue
            p = x[r] @ (d := rng.standard_normal(dim)) / np.linalg.norm(d)
            at, near = np.median(p), forest.spill(loss, p.std(), np.sqrt(0.2 / dim))
            todo += [r[p < at + near], r[p > at - near]]
    assert met.mean() > 0.93 and members / n < 8


@pytest.mark.parametrize("levels, cos", [(8, 0.905), (1, 0.905)])
def test_recall_in_deep_trees(spark, monkeypatch, levels, cos):
    """As deep as for 250,000 vectors: split by the driver's trees, or mostly by tables."""
    monkeypatch.setattr(forest, "LEVELS", levels)
    monkeypatch.setattr(forest.Tree.__init__, "__defaults__", (levels,))
    rows = [(i, v.tolist()) for i, v in enumerate(near_pairs(2000, 64, cos, levels))]
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=80)
    assert 0.9 * 4000 <= got.filter("n_links > 0").count() <= 4000


def test_a_tight_group_is_not_split_apart(spark):
    """Vectors as near each other as linked ones: the spill takes all, and the blocks find every link."""
    rng = np.random.default_rng(8)
    v = forest.normed(rng.normal(size=(1, 16)) + 0.06 * rng.normal(size=(700, 16)))
    rows = [(i, x.tolist()) for i, x in enumerate(np.vstack([v, rng.normal(size=(300, 16))]))]
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=50)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == brute_vectors(rows)


def test_vectors_odd_and_empty(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, inf]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0]), (11, [-1.0]), (12, [3.0]), (7, [1.0, 0.0]), (13, [1e-30, 1e-30])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, key string, rep int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in forest.near_vectors(df).collect())
    assert got == brute_vectors(rows)
    assert forest.near_vectors(df.limit(0)).count() == 0
    assert forest.near_vectors(df.filter("vec_id < 7")).filter("n_links > 0").count() == 0
    null = forest.near_vectors(spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [5.0, -2.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in null) == [(-1, 0, None, True), (-1, 1, 4, False), (4, 1, 4, True)]


def test_vectors_of_null_and_repeated_ids_keep_one_of_each_class(spark):
    rows = [(5, [1.0, 0.0, 0.02]), (None, [1.0, 0.01, 0.0]), (9, [1.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 1.0])]
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == sorted(
        [(5, 2, 5, True), (None, 2, 5, False), (9, 2, 5, False), (9, 1, 9, True), (9, 1, 9, True), (None, 1, None, True), (None, 1, None, True)], key=str
    )


def test_vectors_of_any_size_are_compared_by_direction(spark):
    rows = [(i, [x * s, y * s]) for i, (x, y, s) in enumerate([(1.0, 2.0, 1e200), (1.0, 2.0, 1e-200), (1.0, 2.0, 1.0), (1.0, 2.0, 8e307), (5e-324, 5e-324, 1.0), (1.0, 1.0, 1.0), (-2.0, 1.0, 1e250)])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    # the diagonal has a cosine of 0.949 with the first four
    assert got == {0: (5, 0), 1: (5, 0), 2: (5, 0), 3: (5, 0), 4: (5, 0), 5: (5, 0), 6: (0, 6)}


def test_leaf_links_are_counted_once():
    """A link met in several leaves counts in the least one, whatever the blocks."""
    import pandas as pd

    rng = np.random.default_rng(2)
    n = 30
    v = rng.normal(size=(n, 4))
    payload = [x.tobytes() for x in v]
    linked = forest.cosine_links(0.5)
    want = linked(payload, payload)
    np.fill_diagonal(want, False)
    leaves = [sorted({0, 1, 2} if i < 10 else {1, 2, 3}) for i in range(n)]
    total = Counter()
    for leaf in range(4):
        rows = [i for i in range(n) if leaf in leaves[i]]
        df = pd.DataFrame({"rep": rows, "cnt": [i + 1 for i in rows], "payload": [payload[i] for i in rows], "leaves": [leaves[i] for i in rows]})
        half = len(rows) // 2
        for part in (leafjoin.compare(linked, leaf, df[:half], None), leafjoin.compare(linked, leaf, df[half:], None), leafjoin.compare(linked, leaf, df[:half], df[half:])):
            for r in part.itertuples():
                total[r.rep] += r.links
    assert total == Counter({i: int((want[i] * np.arange(1, n + 1)).sum()) for i in range(n) if want[i].any()})


def test_recall_of_buckets_split_in_all_rounds(spark, monkeypatch):
    """Pairs of similarity just over 0.8 whose shared tokens are nearly all in many sets."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    rng = random.Random(3)
    passages = [" ".join(f"p{i}x{k}" for k in range(60)) for i in range(40)]
    texts = []
    for pair in range(700):
        base = " ".join(rng.sample(passages, 4))
        texts += [base + "".join(f" own{pair}y{side}z{k}" for k in range(28)) for side in range(2)]
    make = jaccard.Shingles()
    want = jaccard.jaccard_links(0.8)(sets := [make(t).astype("<u8").tobytes() for t in texts], sets).sum(1) - 1
    assert want.min() >= 1
    got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_join(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    missed = sum(int(n) - got[i] for i, n in enumerate(want))
    assert missed == 0, missed
    assert jaccard.split_loss(0.8, jaccard.runs_for(), jaccard.pools_for()) <= 1 - jaccard.RECALL


def test_leaves_compared_together_as_each_alone():
    """The leaves of a group, in any order of rows, give what each gives by a call of its own."""
    import pandas as pd

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, (12, 60)).astype("<u8")
    sets = [np.unique(np.concatenate((base[i % 12, : 60 - i % 7], rng.integers(0, 1 << 40, i % 5).astype("<u8")))) for i in range(90)]
    leaves = [sorted({int(i % 12), int(20 + rng.integers(0, 9)), int(40 + i % 4)}) for i in range(90)]
    linked = jaccard.jaccard_links(0.8)
    rows = pd.DataFrame([(leaf, i, 1 + i % 3, sets[i].tobytes(), leaves[i]) for i in range(90) for leaf in leaves[i]], columns=["leaf", "rep", "cnt", "payload", "leaves"])
    alone = pd.concat([leafjoin.compare(linked, int(leaf), of, None) for leaf, of in rows.groupby("leaf")])
    together = leafjoin.compare_each(linked, rows.sample(frac=1, random_state=1))
    assert len(alone) > 50 and Counter(map(tuple, together.to_numpy().tolist())) == Counter(map(tuple, alone.to_numpy().tolist()))
    assert leafjoin.compare_each(linked, rows[rows["rep"] == 0]).empty


@pytest.mark.parametrize("few", [0, 4, 1000])
def test_pairs_one_by_one_and_by_a_matrix(monkeypatch, few):
    """Sets at, over and under 0.8 of each other and the empty set, however many pairs are left by their sizes."""
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = random.Random(6)
    sets = [set(range(8)), set(range(10)), set(), set(), set(range(1000, 1100))] + [set(rng.sample(range(40), rng.randrange(28, 40))) for _ in range(40)]
    payload = [np.array(sorted(s), "<u8").tobytes() for s in sets]
    want = [[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    assert jaccard.jaccard_links(0.8)(payload, payload).tolist() == want
    assert jaccard.jaccard_links(0.8)(payload[:20], payload[7:]).tolist() == [x[7:] for x in want[:20]]


def test_pairs_of_other_sizes_are_not_looked_at(monkeypatch):
    monkeypatch.setattr(jaccard, "shared", None)
    monkeypatch.setattr(jaccard, "shared_by_all", None)
    payload = [np.arange(n, dtype="<u8").tobytes() for n in (10, 20, 40)]
    assert jaccard.jaccard_links(0.8)(payload, payload).tolist() == np.eye(3, dtype=bool).tolist()
