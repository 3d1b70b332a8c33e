import random
import re

import pytest
from pyspark.sql import functions as F

from earshot.functions import phrases as P
from earshot.functions import text as T


def some(rng: random.Random, letters: str, n: int, longest: int) -> list[str]:
    return list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)))


@pytest.mark.parametrize("seed, letters, n", [(1, "ab", 5), (2, "ab ", 14), (3, "abc'.", 60), (4, "abcdefghij k", 900), (5, "a", 3), (6, "aé漢(", 25)])
def test_counted_and_masked_as_one_by_one(spark, seed, letters, n):
    """Few letters, so phrases begin, hold and overlap each other and themselves, in texts of both cases."""
    rng = random.Random(seed)
    given = some(rng, letters, n, 5)
    weights = {p: rng.choice([0.5, 1.0, 2.0]) for p in given}
    texts = ["", *("".join(rng.choice(letters + letters.upper() + " \U0001f600\n") for _ in range(rng.randint(1, 60))) for _ in range(300))]
    want = {}
    for t in texts:
        masked = t
        for p in sorted(given, key=len, reverse=True):
            masked = re.sub(re.escape(p), "<#>", masked, flags=re.I | re.A)
        want[t] = (sum(w * t.lower().count(p) for p, w in weights.items()), masked)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", P.weighted_count(F.lower("t"), weights).alias("n"), P.mask_phrases(F.col("t"), given, "<#>").alias("m")).collect()
    assert {r["t"]: (r["n"], r["m"]) for r in got} == want


def test_null_none_and_tokens_that_phrases_reach(spark):
    df = spark.createDataFrame([(None,), ("to be sure",)], "t string")
    got = df.select(P.weighted_count(F.col("t"), {"be": 1.0}).alias("n"), P.weighted_count(F.col("t"), {}).alias("z"), P.mask_phrases(F.col("t"), [], "x").alias("e"), P.mask_phrases(F.col("t"), ["be"], "x").alias("m")).collect()
    assert [tuple(r) for r in got] == [(None, 0.0, None, None), (1.0, 0.0, "to be sure", "to x sure")]
    assert P.reaches(["be sure"], "to be") and P.reaches(["a"], "[MASK]") and not P.reaches(["we know"], "[#]")
    lexicon = T.Lexicon(strong=(), moderate=(), weak=(), uncertainty=(), certainty_phrases=("ab", "b-"), hedge_phrases=(), soft_phrases=())
    one = spark.createDataFrame([("abb-",)], "t string").select(T.mask_cues(F.col("t"), "-b", lexicon)).first()[0]
    assert one == re.sub("b-", "-b", re.sub("ab", "-b", "abb-"))


def test_patterns_do_not_grow_with_phrases():
    rng = random.Random(9)
    many = [" ".join(some(rng, "abcdefghijklmnop", 2, 9)) for _ in range(1000)]
    assert len(P.layers(many)) <= 4
    pattern = re.compile("(?:" + "|".join(P.trie_pattern(layer) for layer in reversed(P.layers(many))) + ")")
    assert all(pattern.fullmatch(p) for p in many) and not pattern.fullmatch("abcd")
    assert P.layers(["a", "ab", "abc", "b", ""]) == [["a", "b"], ["ab"], ["abc"]] and P.doubled("abab") == ["ababab"]


def test_places_are_few_and_seen_from_the_text(spark):
    text = "xab abab" + "z" * 500 + "AB"
    df = spark.createDataFrame([(text,), ("",), ("zz",), ("a\nb ab",), (None,)], "s string")
    got = [r[0] and [tuple(x) for x in r[0]] for r in df.select(P._places(F.col("s"), ["ab", "a\nb"], 4)).collect()]
    assert got == [[(i, text[i : i + 4]) for i in (1, 4, 6, 508)], [], [], [(0, "a\nb "), (4, "ab")], None]
