"""Many phrases counted or masked in one pass over a text, as patterns made of a trie of the phrases.

At any place of a text at most one phrase of a layer begins, a layer being phrases of which none begins another. So a
layer is one pattern, and what it costs hangs on the text, hardly on how many phrases there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Branches of a trie's node that are tried one after the other; more are halved by their first characters.
BRANCHES = 4
#: Phrases up to which replacing one after another is faster than a pattern.
FEW = 12


def trie_pattern(phrases: Iterable[str]) -> str:
    """A pattern of these phrases, of which none begins another: common beginnings are matched once."""
    phrases = sorted(set(phrases))
    if len(phrases) == 1:
        return re.escape(phrases[0])
    same = 0
    while phrases[0][same] == phrases[-1][same]:  # sorted, so what the first and the last share all share
        same += 1
    by_next: dict[str, list[str]] = {}
    for p in phrases:
        by_next.setdefault(p[same], []).append(p[same:])

    def choice(first: list[str]) -> str:
        if len(first) <= BRANCHES:
            return "(?:" + "|".join(trie_pattern(by_next[c]) for c in first) + ")"
        left, right = first[: len(first) // 2], first[len(first) // 2 :]
        return f"(?:(?=[{''.join(map(re.escape, left))}]){choice(left)}|{choice(right)})"

    return re.escape(phrases[0][:same]) + choice(sorted(by_next))


def layers(phrases: Iterable[str]) -> list[list[str]]:
    """The phrases by how many others each begins with: none of a layer begins another of it."""
    every = {p for p in phrases if p}
    out: dict[int, list[str]] = {}
    for p in sorted(every):
        out.setdefault(sum(p[:k] in every for k in range(1, len(p))), []).append(p)
    return [out[k] for k in sorted(out)]


def doubled(phrase: str) -> list[str]:
    """The shortest texts that hold the phrase twice, overlapping."""
    return [phrase + phrase[k:] for k in range(1, len(phrase)) if phrase[:k] == phrase[-k:]]


def _places(text: Column, first: list[str], size: int) -> Column:
    """An array of (at, seen): each place at which a phrase of the first layer begins, in any case, and the `size` characters from there on.

    Every other phrase begins with one of the first layer, so one pass over the text finds where any can begin. It is cut at these places;
    what is seen from one is joined of the beginnings of the pieces there, not taken from the whole text.
    """
    begins = trie_pattern(first)
    pieces = F.regexp_extract_all(text, F.lit(f"(?is)(.+?)(?={begins}|\\z)"), 1)
    some = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("ats"))
    ends = lambda p: F.aggregate(p, some, lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.array_append(a["ats"], a["at"]).alias("ats")), lambda a: a["ats"])
    head = lambda p: F.transform(p, lambda x: F.substr(x, F.lit(1), F.lit(size)))
    seen = lambda h: F.transform(h, lambda _, i: F.substr(F.array_join(F.slice(h, i + 1, F.lit(size)), ""), F.lit(1), F.lit(size)))
    made = F.transform(F.array(pieces), lambda p: F.arrays_zip(ends(p).alias("at"), F.transform(F.array(head(p)), seen)[0].alias("seen")))[0]
    return F.filter(made, lambda x: (x["at"] > 0) | x["seen"].rlike(f"(?is)^{begins}"))  # the first piece need not begin with one


def count_phrase(text: Column, phrase: Column) -> Column:
    """How often a phrase occurs in text without overlap, inside words too."""
    return ((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("double")


def weighted_count(text: Column, weights: dict[str, float]) -> Column:
    """The sum over phrases of weight times how often the phrase occurs in text, without overlap with itself, inside words too.

    Beyond FEW phrases, one pattern for each layer and weight finds all places at which phrases begin. Only a text in which a phrase overlaps
    itself is counted phrase by phrase, and there only such phrases are.
    """
    out = F.lit(0.0)
    if len(weights) <= FEW:
        for p in weights:
            out = out + count_phrase(text, F.lit(p)) * weights[p]
        return out
    for layer in layers(weights):
        for w in sorted({weights[p] for p in layer}):
            found = F.regexp_count(text, F.lit(f"(?={trie_pattern(p for p in layer if weights[p] == w)})")).cast("double")
            out = out + (found if w == 1 else found * w)
    overlapping = {p: doubled(p) for p in weights if p and doubled(p)}
    if not overlapping:
        return out
    shortest = layers(x for xs in overlapping.values() for x in xs)[0]  # longer ones begin with one of these
    each = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(float(weights[p])).alias("w")) for p in sorted(overlapping)))
    places = lambda p: F.regexp_count(text, F.concat(F.lit("(?=\\Q"), p, F.lit("\\E)"))).cast("double")
    over = F.aggregate(each, F.lit(0.0), lambda sum_, x: sum_ + (count_phrase(text, x["p"]) - places(x["p"])) * x["w"])
    return out + F.when(text.rlike(trie_pattern(shortest)), over).otherwise(0.0)


def mask_phrases(text: Column, phrases: Iterable[str], token: str) -> Column:
    """text with each phrase, in any case, replaced by token as if one phrase after another were, the longest first and
    of equally long ones the first given.

    Beyond FEW phrases, all places where one begins are found at once; they are gone through in that order, and a phrase that overlaps
    one taken before stays. So a phrase never reaches into a mask: for tokens that phrases could, as told by reaches(),
    this is not the same as replacing one after another.
    """
    given = list(dict.fromkeys(p.lower() for p in phrases if p))
    if len(given) <= FEW:
        for p in sorted(given, key=len, reverse=True):
            text = F.regexp_replace(text, f"(?i){re.escape(p)}", re.sub(r"([\\$])", r"\\\1", token))
        return text
    every = layers(given)
    tied = _tied(given)  # which of two equally long phrases comes first is told by their order
    by_length = sorted(given, key=len)
    in_order = all(p < q for p, q in zip(by_length, by_length[1:]) if len(p) == len(q))  # given in the order of the phrases themselves
    order = F.array(*map(F.lit, given))
    rank_of = lambda m: (F.lower(m) if in_order else F.lpad(F.array_position(order, F.lower(m)).cast("string"), 12, "0")) if tied else F.lit("")
    matches = lambda x: F.array(*(F.regexp_extract(x["seen"], f"(?is)^(?:{trie_pattern(layer)})", 0) for layer in every))
    entry = lambda x: F.transform(F.filter(matches(x), lambda m: m != ""), lambda m: F.struct((-F.length(m)).alias("rank"), rank_of(m).alias("given"), x["at"].alias("at")))
    places = F.array_sort(F.flatten(F.transform(_places(text, every[0], max(map(len, given))), entry)))
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["at"] < x["at"] - x["rank"]) & (x["at"] < t["at"] - t["rank"]))
    none = F.expr("cast(array() as array<struct<rank:int,given:string,at:int>>)")
    taken = F.aggregate(places, none, lambda t, x: F.when(free(t, x), F.array_append(t, x)).otherwise(t))
    by_place = F.array_sort(F.transform(taken, lambda x: F.struct(x["at"].alias("at"), (x["at"] - x["rank"]).alias("to"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    joined = F.aggregate(
        by_place, begin, lambda b, x: F.struct(F.concat(b["out"], F.substr(text, b["at"] + 1, x["at"] - b["at"]), F.lit(token)).alias("out"), x["to"].alias("at")),
        lambda b: F.concat(b["out"], F.substr(text, b["at"] + 1)),
    )
    return joined


def _tied(phrases: list[str]) -> bool:
    """Whether an end of a phrase is a beginning of another one of the same length."""
    heads = {(len(p), p[:k]) for p in phrases for k in range(1, len(p))}
    return any((len(p), p[k:]) in heads and any(q != p and len(q) == len(p) and q.startswith(p[k:]) for q in phrases) for p in phrases for k in range(1, len(p)))


def reaches(phrases: Iterable[str], token: str) -> bool:
    """Whether a phrase could match a part of a token, or part of one and text beside it."""
    t = token.lower()
    return any(p in t or t in p or any(p.startswith(t[-k:]) or t.startswith(p[-k:]) for k in range(1, min(len(p), len(t)) + 1)) for p in map(str.lower, phrases) if p)
