"""Mixing sources to target weights by fitting word budgets with whole documents.

Documents are counted by source and exact length. Every source's budget is first dealt out in proportion to these counts, then classes in a seeded order
get one copy more, and what is left of the budget is met by a bounded-knapsack dynamic program over the remaining copies of each length. How many copies
each length gets decides which documents are taken: every one of the length as often as all can be, and the first ones in a seeded order once more.

The histogram of a source has at most as many rows as its longest text has words, so the plan of one source fits wherever its longest text does.
Documents of one length are ranked in hash buckets, never as one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import cut, mixed

REPEATS = 3
WEIGHTS = 3
SEED = 11
# Words of a budget that the dynamic program fits exactly.
WINDOW = 8192
BUCKETS = 1024


def words(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _fitted(lengths: np.ndarray, left: np.ndarray, rest: int, order: np.ndarray) -> np.ndarray:
    """Copies of each length, at most ``left``, whose sum is nearest to ``rest``; of two equally near sums the smaller. Bounded-knapsack reachability."""
    used = np.zeros(len(lengths), np.int64)
    open_ = order[left[order] > 0]
    if rest <= 0 or not len(open_):
        return used
    top = rest + min(rest, int(lengths[open_].max()))  # a sum above is of use only if nearer than none at all
    reached, by = np.zeros(top + 1, bool), np.full(top + 1, -1)
    reached[0] = True
    for k in open_[lengths[open_] <= top].tolist():
        if reached[rest]:
            break
        size, fresh = int(lengths[k]), reached
        for _ in range(min(int(left[k]), top // size)):
            new = np.zeros(top + 1, bool)
            new[size:] = fresh[: top + 1 - size]
            new &= ~reached
            if not new.any():
                break
            reached = reached | new
            by[new] = k
            fresh = new
    sums = np.flatnonzero(reached)
    best = int(sums[np.abs(sums - rest).argmin()])
    while best:
        k = by[best]
        used[k] += 1
        best -= int(lengths[k])
    return used


def plan(lengths: np.ndarray, counts: np.ndarray, budget: int, repeats: int = REPEATS, window: int = WINDOW, seed: int = SEED) -> np.ndarray:
    """Copies of each length whose words come nearest to ``budget``; at most ``repeats`` of each document. Lengths are distinct; those of 0 get none."""
    copies = np.zeros(len(lengths), np.int64)
    total = int((lengths.astype(object) * counts).sum()) if len(lengths) else 0
    budget = max(0, min(budget, repeats * total))
    if not budget:
        return copies
    copies = np.where(lengths > 0, (counts.astype(object) * budget // total), 0).astype(np.int64)
    left = np.where(lengths > 0, repeats * counts - copies, 0)
    rest = budget - int((lengths.astype(object) * copies).sum())
    order = np.argsort(mixed(lengths.astype(np.uint64) + np.uint64(seed << 32)), kind="stable")
    while rest > 2 * window:  # each class once more, in seeded order, down to what the dynamic program takes
        fits = order[(left[order] > 0) & (lengths[order] <= rest - window)]
        fits = fits[np.cumsum(lengths[fits]) <= rest - window]
        if not len(fits):
            break
        copies[fits] += 1
        left[fits] -= 1
        rest -= int(lengths[fits].sum())
    if rest > 2 * window:  # only documents longer than the rest less the window remain: one of them, or none
        near = order[left[order] > 0]
        if len(near):
            k = near[np.abs(lengths[near] - rest).argmin()]
            if abs(int(lengths[k]) - rest) < rest:
                copies[k] += 1
                left[k] -= 1
                rest -= int(lengths[k])
    if 0 < rest <= 2 * window:
        copies += _fitted(lengths, left, rest, order)
    return copies


def targets(sources: DataFrame, repeats: int = REPEATS, weights: int = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares of all sizes by weights 1, 2, ... ``weights``, repeating over the sources by code point (null
    last); what exceeds ``repeats`` times a source's size goes to the others by weight, until none is above.

    A source stands above exactly where the level (words per weight) of those below would lift it above, and the level only rises, so every round is one sum.
    """
    by = F.col("source").asc_nulls_last()
    placed = cut(sources.repartitionByRange(by).sortWithinPartitions(by).withColumn("at", F.monotonically_increasing_id()))
    part, mask = F.shiftright("at", 33), (1 << 33) - 1
    before = placed.groupBy(part.alias("part")).count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit(mask))
    ranked = placed.withColumn("part", part).join(before.drop("count"), "part").withColumn("weight", rank % weights + 1)
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    size, share = F.col("source_size").cast("decimal(20,0)"), F.col("weight").cast("decimal(10,0)")
    rest = total or 0
    while True:
        above = share * F.lit(rest).cast("decimal(20,0)") > size * F.lit(repeats * (weight or 1)).cast("decimal(18,0)")
        full, free = ranked.agg(F.sum(F.when(above, repeats * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if not free or (rest, weight) == ((total or 0) - (full or 0), free):
            break
        rest, weight = total - (full or 0), free
    even = (share * F.lit(rest).cast("decimal(20,0)")).cast("double") / F.lit(float(weight or 1))
    return ranked.select("source", "source_size", F.when(above, (repeats * F.col("source_size")).cast("double")).otherwise(even).alias("target"))


def mixture(docs: DataFrame, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row: ``taken`` is 0 to ``repeats`` times the size, and the words taken of a source are as near to its
    target as whole documents allow (to the word, where some sum of lengths meets it).

    Null texts have size 0 and are not taken. A null source is a source of its own, the last. Rows that are alike share a rank; which of them is taken once
    more makes no difference. Null ids are ordered like others. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS)).cast("int")
    sized = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), bucket.alias("bucket")))
    parts = cut(sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")))
    classes = parts.groupBy("source", "size").agg(F.sum("n").alias("n_docs"))
    aims = cut(targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n_docs")).alias("source_size")), repeats))
    a = aims.withColumnRenamed("source", "aim")

    def planned(group: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = group["size"].to_numpy(np.int64), group["n_docs"].to_numpy(np.int64)
        return group.assign(copies=plan(lengths, counts, int(group["target"].iloc[0] + 0.5), repeats, WINDOW, seed))

    schema = "source string, size long, n_docs long, source_size long, target double, copies long"
    copies = classes.join(a, F.col("source").eqNullSafe(F.col("aim"))).drop("aim").groupBy("source").applyInPandas(planned, schema)
    c = copies.select(F.col("source").alias("of"), F.col("size").alias("length"), "n_docs", "source_size", "target", "copies")
    so_far = Window.partitionBy("source", "size").orderBy("bucket")
    more = F.col("copies") % F.col("n_docs") - (F.sum("n").over(so_far) - F.col("n"))
    dealt = parts.join(c, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("length"))).select(
        F.col("source").alias("of"), F.col("size").alias("length"), F.col("bucket").alias("part"), "source_size", "target",
        F.floor(F.col("copies") / F.col("n_docs")).alias("each"), more.alias("more"),
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    own = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("length")) & (F.col("bucket") == F.col("part"))
    taken = F.col("size") * (F.col("each") + (F.col("rank") <= F.col("more")).cast("long"))
    return sized.join(dealt, own).withColumn("rank", rank).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
