from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from test_packing_tokens import check_pack
from test_similarity import brute_join

from earshot.llm import quality, toxicity
from earshot.llm.common import read_table
from earshot.llm.queries import ORACLES


def test_every_stage_by_brute_force(spark, sf_dir, tmp_path):
    """Each stage over its own input: models applied row by row, classes by all pairs, the mix by SQL, packing by its rules."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    columns = docs.columns
    key = lambda df: Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "toxicity", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{k}")
            out = spark.read.parquet(f"{tmp_path}/{k}")
            got = key(out.collect())
        if name == "quality classifier":
            m = quality.train(docs, labels)
            s = m.score(np.vstack([quality.text_features([r["text"]]) for r in before]), np.array([quality.metadata_features(r["lang"], r["source"], r["n_chars"]) for r in before]))
            assert got == key([r for r, x in zip(before, s) if x >= 0.5]) and 0 < sum(got.values()) < len(before)
        elif name == "toxicity":
            w = toxicity.train(docs, labels)
            make, dense = toxicity.Features(w.bits), w.dense()
            assert got == key([r for r in before if toxicity.score_of(make(r["text"]), dense, w.bias) < 0.3]) and sum(got.values()) < len(before)
        elif name == "n-gram Jaccard join":
            keep = {d for d, c, _ in brute_join([(r["doc_id"], r["text"]) for r in before]) if d == c}
            assert got == key([r for r in before if r["doc_id"] in keep]) and sum(got.values()) < len(before)
        elif name == "mixing sources":
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{k - 1}/*.parquet')")
            taken = {d: t // n if n else 0 for d, n, t in con.execute(f"SELECT doc_id, size, taken FROM ({ORACLES['op7_mixing']})").fetchall()}
            want = Counter({x: n * taken[x[0]] for x, n in key(before).items() if taken[x[0]]})
            assert Counter({x: n for x, n in got.items() if (x[1] or "").strip()}) == Counter({x: n for x, n in want.items() if (x[1] or "").strip()})
        else:
            sequences, total = check_pack(out, before, 4096)
            assert sequences <= -(-total // 4096) + 1
        docs = out


def test_run_equals_the_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    row = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert row(corpus_pipeline.run(spark, sf_dir)) == row(docs)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_odd_and_empty(spark, sf_dir, odd_docs, no_docs, name, stage):
    """Nulls, blanks, long texts, repeats, clashing columns: every row is judged, none is lost but by the stage's rule."""
    out = stage(spark, odd_docs, sf_dir)
    got, rows = out.collect(), odd_docs.collect()
    if name == "best-fit packing":
        assert check_pack(out, rows, 4096)[0] >= 1
    else:
        assert out.columns == odd_docs.columns
        assert not Counter((r["doc_id"], r["text"]) for r in got) - Counter({k: 3 * n for k, n in Counter((r["doc_id"], r["text"]) for r in rows).items()})
    if name == "n-gram Jaccard join":
        assert sorted((r["doc_id"] or -1) for r in got) == [-1, -1, 1, 2, 3, 4, 5, 6, 8, 9]
    if name == "toxicity":
        assert sum(not (r["text"] or "").strip() for r in got) == sum(not (r["text"] or "").strip() for r in rows)
    empty = stage(spark, no_docs, sf_dir)
    assert empty.count() == 0 and (name == "best-fit packing" or empty.columns == no_docs.columns)
