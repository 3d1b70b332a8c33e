import itertools
import json
import operator
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from earshot.llm import tokens
from earshot.llm.packing import _Fillings, best_fit, bin_completion, lower_bound, pack, slots
from earshot.llm.token_counts import at_limit, context_limits, length_histogram, token_lengths
from earshot.llm.tokens import WordTokenizer, byte_tokenizer, word_tokenizer

WORD, BYTE = str(public_tokenizers.path("word_bpe_49k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def valid(hist, patterns, capacity):
    used = Counter()
    for p in patterns:
        assert p.bins > 0 and sum(k * n for k, n in p.items) <= capacity
        for k, n in p.items:
            used[k] += n * p.bins
    assert used == Counter({k: n for k, n in hist.items() if n})
    return sum(p.bins for p in patterns)


def fewest(items: list[int], capacity: int) -> int:
    """Fewest bins by trying all places, for a handful of items."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1 :])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=0, max_size=9))
def test_few_items_by_brute_force(items):
    hist = dict(Counter(items))
    n = valid(hist, bin_completion(hist, 30), 30)
    best = fewest(sorted(items, reverse=True), 30)
    assert lower_bound(hist, 30) <= best <= n <= valid(hist, best_fit(hist, 30), 30)
    assert n == best


def test_completion_gains_where_best_fit_misses_the_bound():
    rng, n, gained = np.random.default_rng(0), 0, 0
    while n < 300:
        items = rng.integers(2, 31, rng.integers(8, 13)).tolist()
        hist = dict(Counter(items))
        by_best_fit = valid(hist, best_fit(hist, 30), 30)
        if by_best_fit > lower_bound(hist, 30):
            n += 1
            found = valid(hist, bin_completion(hist, 30), 30)
            assert found == fewest(sorted(items, reverse=True), 30)
            gained += found < by_best_fit
    assert gained > 30
    hist = dict(Counter(rng.integers(1000, 1700, 3000).tolist()))
    assert valid(hist, bin_completion(hist, 4096), 4096) < 0.95 * valid(hist, best_fit(hist, 4096), 4096)


def test_fillings_are_the_undominated_ones():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = sorted(rng.choice(np.arange(1, 14), 5, replace=False).tolist())
        counts, room = rng.integers(1, 3, 5).tolist(), int(rng.integers(1, 25))
        sets = [s for s in itertools.product(*(range(c + 1) for c in counts)) if sum(map(operator.mul, s, lengths)) <= room]

        def parts(s, t):  # whether the pieces of s can be put into bins as large as those of t, each at most once
            items = [x for x, k in zip(lengths, s) for _ in range(k)][::-1]

            def go(i, bins):
                return i == len(items) or any(bins[j] >= items[i] and go(i + 1, bins[:j] + [bins[j] - items[i]] + bins[j + 1 :]) for j in range(len(bins)))

            return go(0, [x for x, k in zip(lengths, t) for _ in range(k)])

        want = {s for s in sets if not any(t != s and parts(s, t) for t in sets)}
        got = [tuple(dict(items).get(x, 0) for x in lengths) for _, items in _Fillings(lengths, counts, room).upto(room, [10**6])]
        assert len(got) == len(set(got)) and set(got) == want


def test_many_items_reach_the_bound():
    rng = np.random.default_rng(0)
    for draw in (lambda: rng.integers(1000, 4000, 20_000), lambda: np.clip(np.exp(rng.normal(5.8, 1.1, 20_000)).astype(int) + 1, 1, 4096)):
        hist = dict(Counter(draw().tolist()))
        assert valid(hist, bin_completion(hist, 4096), 4096) <= lower_bound(hist, 4096) + 1


def test_slots_are_gapless():
    hist = {7: 5, 3: 11, 2: 4, 1: 1}
    patterns = bin_completion(hist, 12)
    places = Counter()
    for length, rows in slots(patterns).items():
        n = 0
        for (first, seq, bins, offset), nxt in zip(rows, [*rows[1:, 0], hist[length]]):
            assert first == n
            for k in range(first, nxt):
                i = k - first
                for at in range(offset + i // bins * length, offset + (i // bins + 1) * length):
                    places[seq + i % bins, at] += 1
            n = nxt
    assert max(places.values()) == 1 and len(places) == sum(k * n for k, n in hist.items())


def check_pack(got, docs, capacity):
    rows = [r.asDict() for r in got.collect()]
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    encode = Tokenizer.from_file(WORD).encode
    want = Counter()
    for d in docs:
        ids = np.array([*encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d["doc_id"], k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    return len(seqs), sum(r["length"] for r in rows)


def test_pack_odd_and_empty(odd_docs, no_docs):
    docs = odd_docs.collect()
    n, total = check_pack(pack(odd_docs, WORD), docs, 4096)
    assert n == -(-total // 4096)
    check_pack(pack(odd_docs, WORD, capacity=7), docs, 7)
    assert pack(no_docs, WORD).count() == 0


def test_pack_returns_ids_that_decode(odd_docs):
    got = pack(odd_docs.filter("doc_id = 6"), WORD, with_ids=True).orderBy("piece").collect()
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    text = odd_docs.filter("doc_id = 6").first()["text"]
    assert ids[-1] == 1 and ids[:-1].tolist() == Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids


ODD = ["It's the dog's 'tail' don't we've... ok!? a_b __x__ ", "Ünï ²³ 5x10 ¼ ª b", "a\x1cb c", "x <|endoftext|> y <|end", "“quoted” naïve — café’s", "ÀÉ!? (foo) [bar], {b}", "a\xadb c d\x85e\xa0f", "İstanbul ΣΑΣ ΑΣ.", "", "   ", "e\u0301x", "it's' rock'n'roll 'twas", "漢字 かな"]


def test_word_ids_equal_the_tokenizer():
    t = word_tokenizer(WORD)
    rng = random.Random(3)
    alphabet = "abzAZéÉßøÿ09²¼.,!?'*&|_- \t\n\x85\xa0\xad"
    for x in ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]:
        assert np.frombuffer(t.ids(x), "<u4").tolist() == t._tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_word_ids_of_any_text(x):
    x = x.encode("utf-8", "replace").decode()
    t = word_tokenizer(WORD)
    assert np.frombuffer(t.ids(x), "<u4").tolist() == t._tokenizer.encode(x, add_special_tokens=False).ids


def test_word_ids_with_little_memory_and_long_texts(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 2000)
    monkeypatch.setattr(tokens, "SEGMENT", 400)
    rng = random.Random(4)
    t = WordTokenizer(WORD)
    texts = [*ODD, None, " ".join("".join(rng.choice("abcdé,.Z") for _ in range(rng.randint(1, 9))) for _ in range(3000)), "x" * 3000, "y" * 70 + " a\x1cb " + "z " * 500]
    for _ in range(2):
        for x, ids in zip(texts, t.encode(pa.array(texts, pa.string()))):
            assert np.frombuffer(ids, "<u4").tolist() == t._tokenizer.encode(x or "", add_special_tokens=False).ids
    assert t.encode(pa.array([], pa.string())) == []


def test_a_vocabulary_is_read_once(monkeypatch):
    """By its tokenizer only: read by json as well, its merges double what a worker takes."""
    monkeypatch.setattr(json, "load", lambda f: pytest.fail("the whole file was read by json"))
    assert WordTokenizer(WORD)._by_words


def test_another_vocabulary_goes_by_its_own_rules(tmp_path):
    described = json.load(open(WORD, encoding="utf-8"))
    described["normalizer"]["normalizers"].pop()  # keeps upper case
    path = tmp_path / "v.json"
    path.write_text(json.dumps(described))
    t = WordTokenizer(str(path))
    assert np.frombuffer(t.ids("The Cat, a DOG"), "<u4").tolist() == Tokenizer.from_file(str(path)).encode("The Cat, a DOG", add_special_tokens=False).ids


def test_token_counts_by_brute_force(odd_docs, no_docs):
    bpe = byte_tokenizer(BYTE)
    lengths = token_lengths(odd_docs, BYTE, keep=("lang", "doc_id"))
    rows = odd_docs.collect()
    want = sorted((r["lang"] or "", r["doc_id"] or 0, len(bpe.encode_ordinary(r["text"] or ""))) for r in rows)
    assert sorted((r["lang"] or "", r["doc_id"] or 0, r["n_tokens"]) for r in lengths.collect()) == want
    limits = context_limits(length_histogram(lengths, "lang"))
    by = {}
    for lang, _, n in want:
        by.setdefault(lang, []).append(n)
    got = limits.collect()
    for r in got:
        if r["grp"] in (None, ""):
            continue
        n = by[r["grp"]]
        limit = r["context_limit"]
        assert r["docs"] == n.count(limit) and r["docs_over"] == sum(x > limit for x in n) and r["docs_upto"] == sum(x <= limit for x in n)
        assert r["tokens_upto"] == sum(x for x in n if x <= limit) and r["tokens_truncated"] == sum(min(x, limit) for x in n)
        assert r["tokens_lost"] == sum(max(0, x - limit) for x in n) and r["tokens_total"] == sum(n) and r["quantile"] == r["docs_upto"] / len(n)
    for limit in (0, 1, 3, 50, 2000, 10**6):
        for r in at_limit(limits, limit).collect():
            if r["grp"] not in (None, ""):
                n = by[r["grp"]]
                assert (r["tokens_truncated"], r["docs_over"], r["tokens_lost"]) == (sum(min(x, limit) for x in n), sum(x > limit for x in n), sum(max(0, x - limit) for x in n))
    assert context_limits(length_histogram(token_lengths(no_docs, BYTE))).count() == 0
