"""Links between members of shared leaves: each link counted once, no pair ever written.

Both similarity operators deal their distinct items to leaves so that similar ones meet in at least one. Here members of
a leaf are compared, links counted and components formed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import checkpointed, give_back, small_join, weighted_join
from earshot.llm.graph import components

#: Members, and MB of what is compared, of a block: a leaf with more is compared block by block.
BLOCK, BLOCK_MB = 512, 24
#: Members, and MB, of the leaves of one block that are compared by one call, about.
TOGETHER, TOGETHER_MB = 128, 1

#: Given the payloads of some members and of others, which of them are linked.
Linked = Callable[[list[bytes], list[bytes]], np.ndarray]


def _first_met(a: list, b: list, leaf: int) -> np.ndarray:
    """Whether leaf is the least leaf that each of a shares with each of b; lists of leaves, all with leaf in them."""
    low_a, low_b = [[x for x in v if x < leaf] for v in a], [[x for x in v if x < leaf] for v in b]
    column = {x: i for i, x in enumerate({x for v in low_a for x in v} & {x for v in low_b for x in v})}
    if not column:
        return np.ones((len(a), len(b)), bool)

    def marks(lists: list) -> np.ndarray:
        out = np.zeros((len(lists), len(column)), np.float32)
        for i, v in enumerate(lists):
            out[i, [column[x] for x in v if x in column]] = 1
        return out

    return marks(low_a) @ marks(low_b).T < 0.5


def _roots(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each member the least id that links lead to."""
    root, most = ids.copy(), np.iinfo(np.int64).max
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], most).min(1))
        if (least == root).all():
            return root
        root = least


#: rep, cnt and leaves of some members.
Members = tuple[np.ndarray, np.ndarray, np.ndarray]


def _members(rows: pd.DataFrame) -> Members:
    return rows["rep"].to_numpy(np.int64), rows["cnt"].to_numpy(np.float64), rows["leaves"].to_numpy()


def _counted(hit: np.ndarray, leaf: int, a: Members, b: Members, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links, root) of the members of a and b with a link of hit that no lesser leaf has."""
    at, bt = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    hit = hit[np.ix_(at, bt)]
    hit = hit & _first_met(*([np.asarray(v).tolist() for v in x[2][t]] for x, t in ((a, at), (b, bt))), leaf)
    ids_a, ids_b = a[0][at], b[0][bt]
    links_a = hit.astype(np.float64) @ b[1][bt]
    if same:
        reps, links, square = ids_a, links_a, hit
    else:
        reps = np.concatenate([ids_a, ids_b])
        links = np.concatenate([links_a, hit.T.astype(np.float64) @ a[1][at]])
        square = np.zeros((len(reps), len(reps)), bool)
        square[: len(ids_a), len(ids_a) :] = hit
        square[len(ids_a) :, : len(ids_a)] = hit.T
    some = links > 0
    return reps[some], links[some].astype(np.int64), _roots(reps, square)[some]


def _table(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    return pd.DataFrame(dict(zip(("rep", "links", "root"), columns)))


def compare(linked: Linked, leaf: int, a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
    """(rep, links, root) of members with a link in this leaf: how many items they are linked to here for the first time.

    a, b: rep, cnt, payload, leaves of two blocks; b None: of the pairs within a. Empty if nothing is linked.
    """
    same = b is None
    b = a if same else b
    hit = linked(a["payload"].tolist(), b["payload"].tolist())
    if same:
        np.fill_diagonal(hit, False)
    return _table([_counted(hit, leaf, _members(a), _members(b), same)] if hit.any() else [])


def compare_each(linked: Linked, rows: pd.DataFrame) -> pd.DataFrame:
    """What compare gives within each of several leaves. rows: leaf, rep, cnt, payload, leaves."""
    leaf = rows["leaf"].to_numpy(np.int64)
    order = np.argsort(leaf, kind="stable")
    leaf, payload, (rep, cnt, leaves) = leaf[order], rows["payload"].to_numpy()[order], (x[order] for x in _members(rows))
    ends = [*(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)]
    found = []
    for lo, hi in zip([0, *ends], ends):
        members = payload[lo:hi].tolist()
        hit = linked(members, members)
        np.fill_diagonal(hit, False)
        if hit.any():
            some = rep[lo:hi], cnt[lo:hi], leaves[lo:hi]
            found.append(_counted(hit, int(leaf[lo]), some, some, True))
    return _table(found)


def leaf_sizes(paths: DataFrame) -> DataFrame:
    """(leaf, members, mb) of leaves with two members at least. paths: leaf, rep, bytes."""
    return paths.groupBy("leaf").agg(F.count("*").alias("members"), (F.sum("bytes") / 1e6).alias("mb")).filter("members > 1")


def link_leaves(members: Callable[[DataFrame], DataFrame], paths: DataFrame, linked: Linked, block: int | None = None) -> DataFrame:
    """(rep, links, component) of all items with a link to another one.

    paths: (leaf, rep, bytes), each pair once, checkpointed. members: gives (rep, cnt, payload) for a table of the reps
    that share a leaf, each once. Each leaf's members are compared in blocks of about `block` (BLOCK): a leaf of n members
    makes (n / block)^2 / 2 groups of two blocks, however alike they are. A link found in several leaves counts in the least.
    Leaves of one block, most of which have two or three members, are grouped by a hash to about TOGETHER members, as a
    call for each of them takes longer than what is compared in it.
    """
    sizes = leaf_sizes(paths).withColumn("blocks", F.greatest(F.ceil(F.col("members") / (block or BLOCK)), F.ceil(F.col("mb") / BLOCK_MB)).cast("int"))
    sizes = checkpointed(sizes)
    whole = sizes.filter("blocks = 1").agg(F.sum("members").alias("members"), F.sum("mb").alias("mb")).first()
    together = int(max((whole["members"] or 0) / TOGETHER, (whole["mb"] or 0) / TOGETHER_MB)) + 1
    shared = weighted_join(paths.select("leaf", "rep"), sizes.select("leaf", "blocks", "members"), "leaf", "members")
    lists = checkpointed(shared.groupBy("rep").agg(F.collect_list(F.struct("leaf", "blocks")).alias("at")))
    rows = members(lists.select("rep")).join(lists, "rep").withColumn("leaves", F.col("at.leaf"))
    dealt = rows.withColumn("at", F.explode("at")).select("rep", "cnt", "payload", "leaves", "at.leaf", "at.blocks")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", "leaf"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group, i = F.when(F.col("blocks") > 1, F.col("leaf")).otherwise(F.pmod(F.xxhash64("leaf"), F.lit(together))), F.when(F.col("blocks") > 1, F.least("block", "other")).otherwise(-1)
    dealt = dealt.select("rep", "cnt", "payload", "leaves", "leaf", "block", group.alias("group"), i.alias("i"), F.greatest("block", "other").alias("j"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        leaf, i, j = key
        give_back()  # of the groups before
        if i < 0:
            return compare_each(linked, rows)
        if i == j:
            return compare(linked, int(leaf), rows, None)
        a, b = rows[rows["block"] == i], rows[rows["block"] == j]
        return compare(linked, int(leaf), a, b)

    found = checkpointed(dealt.groupBy("group", "i", "j").applyInPandas(run, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    return links.join(tied.withColumnRenamed("node", "rep"), "rep")


def split_large(paths: DataFrame, most: int, split: Callable[[DataFrame, int], DataFrame], rounds: int) -> DataFrame:
    """paths with leaves of over `most` members split again and again.

    split: from (leaf, rep, bytes, step) of large leaves and the number of the round to (leaf, child, rep, bytes), a rep
    in one child or several. A leaf of which one child keeps over four fifths is left whole, as its members are too alike
    to split; the blocks of link_leaves are the exact way for it. So are leaves that are still large after all rounds.
    """
    done = None
    now = checkpointed(paths)
    for step in range(rounds):
        sizes = checkpointed(now.groupBy("leaf").agg(F.count("*").alias("members")).filter(F.col("members") > most))
        n = sizes.count()
        if n == 0:
            break
        large = small_join(now, sizes, ["leaf"], "inner", n)
        children = checkpointed(split(large.select("leaf", "rep", "bytes"), step))
        largest = children.groupBy("leaf", "child").count().groupBy("leaf").agg(F.max("count").alias("c"))
        stuck = checkpointed(largest.join(sizes, "leaf").filter(F.col("c") > 0.8 * F.col("members")).select("leaf"))
        n_stuck = stuck.count()
        small = now.join(F.broadcast(sizes.select("leaf")), "leaf", "left_anti") if n <= 100_000 else now.join(sizes.select("leaf"), "leaf", "left_anti")
        kept = small_join(now, stuck, ["leaf"], "inner", n_stuck) if n_stuck else None
        ended = small if kept is None else small.unionByName(kept.select(*small.columns))
        done = ended if done is None else done.unionByName(ended)
        going = children if not n_stuck else (children.join(F.broadcast(stuck), "leaf", "left_anti") if n_stuck <= 100_000 else children.join(stuck, "leaf", "left_anti"))
        now = checkpointed(going.select(F.col("child").alias("leaf"), "rep", "bytes").distinct())
    return now if done is None else checkpointed(done.unionByName(now))
