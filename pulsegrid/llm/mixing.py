"""Mixing sources to target weights by subset sums.

Each source has a target of words. It is read whole as often as that fits; what
remains is filled exactly: documents are counted by length, an even share of
every length is taken, then the longest that fit, and a bounded knapsack over a
window of the last words exchanges documents until the sum meets the budget (or
comes as near below as lengths allow). Which documents of a length are taken is
by a seeded hash, in cells of a bounded number of rows, so that no source or
length is ranked in one task.

Targets: sources in the order of code points, null last, weigh 1, 2, 3, 1, ...
They share the whole number of words; what would exceed three times a source's
words is shared again among the others by weight.

Targets rank the sources in one task: it holds a row for each source, not for
each document.

Defined cases: a null text has size 0 and takes 0; a source without words has
target 0; repeated rows with equal id and text are interchangeable, and where
they are more than HOT, which of them are taken depends on the layout of the
input; a text of any length is one document of one length; an empty table gives
an empty one; columns of the input may have any names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, materialise, table

SEED, MOST = 9, 3
#: Words that the last knapsack may move, and rows that one cell is meant to hold.
WINDOW, CELL = 16_384, 4_096
#: Rows of a plan that may be broadcast, and of one id and text that may be ranked in one cell.
BROADCAST_ROWS, HOT = 200_000, 1_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size) -> and target. One row a source; the level at which capped sources stop is found by sorted prefix sums."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(every) - 1) % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    all_rows = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(all_rows)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    w = w.withColumn("level", level).withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(all_rows))
    return w.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length (ascending, above 0) to take so that their words sum to budget, or as near below as the search finds."""
    total = int(lengths @ counts)
    if not total or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    budget = min(budget, total)
    take = np.minimum((counts.astype(object) * budget) // total, counts).astype(np.int64)
    left = budget - int(lengths @ take)
    for i in range(len(lengths) - 1, -1, -1):
        more = min(int(counts[i] - take[i]), left // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    if not left:
        return take
    # Gives back short documents for a window of words, then fills that exactly.
    for i in range(len(lengths)):
        if left >= window:
            break
        back = min(int(take[i]), max(0, (window - left)) // int(lengths[i]))
        take[i] -= back
        left += back * int(lengths[i])
    reach, steps = 1, []
    mask = (1 << (left + 1)) - 1
    for i in np.flatnonzero((counts > take) & (lengths <= left))[::-1]:
        free, size, part = int(counts[i] - take[i]), int(lengths[i]), 1
        free = min(free, left // size)
        while free and not reach >> left & 1:
            part = min(part, free)
            steps.append((i, part, reach))
            reach |= (reach << part * size) & mask
            free -= part
            part *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            take[i] += part
            at -= part * int(lengths[i])
    return take


def nearest(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Filled from below, or from above by what is left out, whichever comes nearer to budget."""
    total = int(lengths @ counts)
    below = fill(lengths, counts, budget)
    if int(lengths @ below) >= min(budget, total):
        return below
    above = counts - fill(lengths, counts, total - budget)
    return above if int(lengths @ above) - budget < budget - int(lengths @ below) else below


def length_plan(lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, n) and targets -> (source, size, n, whole, extra): whole reads of all, and documents of that size to take once more."""

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        own, target = int(rows["source_size"].iloc[0]), round(float(rows["target"].iloc[0]))
        whole = target // own if own else 0
        size, n = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        extra, words = np.zeros(len(rows), np.int64), size > 0
        extra[words] = nearest(size[words], n[words], target - whole * own)
        left = target - whole * own - int(extra @ size)
        if left > 0:  # once more of each doesn't meet the budget: up to MOST times
            extra[words] += fill(size[words], n[words] * (MOST - whole) - extra[words], left)
        return rows.assign(whole=whole + extra // n, extra=extra % n)

    return lengths.join(targets, lengths.source.eqNullSafe(targets.source)).drop(targets.source).groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, whole long, extra long")


def numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, carry: dict[str, str], hot: int) -> DataFrame:
    """A table of rows with a row number, size and mark, and the columns of carry under its names.

    A mark is a seeded hash of id and text. Where more than hot rows have one, it
    takes in the row number, or they would all be ranked in one task.
    """
    mark = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.select(F.monotonically_increasing_id().alias("no"), F.col(id_col).cast("long").alias("doc_id"), size_of(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"), mark.alias("mark"), *(F.col(f"`{c}`").alias(n) for n, c in carry.items()))
    rows = materialise(rows)
    often = rows.groupBy("mark").count().where(F.col("count") > hot).select(F.col("mark").alias("hot"))
    if often.isEmpty():
        return rows
    often = materialise(often)
    few = F.broadcast if often.count() <= BROADCAST_ROWS else lambda df: df
    mark = F.when(F.col("hot").isNotNull(), F.xxhash64("mark", "no")).otherwise(F.col("mark"))
    return rows.join(few(often), rows.mark == often.hot, "left").withColumn("mark", mark).drop("hot")


def selection(rows: DataFrame) -> DataFrame:
    """(no, doc_id, size, source, source_size, target, mark, times) of numbered rows."""
    rows = rows.select("no", "doc_id", "size", "source", "mark")
    lengths = materialise(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    plan = materialise(length_plan(lengths, targets).withColumn("cells", F.expr(f"1 + n div {CELL}")))
    plan = plan.withColumnsRenamed({"source": "p_source", "size": "p_size"})
    few = plan.count() <= BROADCAST_ROWS
    with_plan = lambda df: df.join(F.broadcast(plan) if few else plan, df.source.eqNullSafe(F.col("p_source")) & (df.size == F.col("p_size"))).drop("p_source", "p_size")
    key = ["source", "size"]
    rows = with_plan(rows).withColumn("cell", F.when(F.col("extra").between(1, F.col("n") - 1), F.pmod(F.shiftrightunsigned("mark", 20), F.col("cells"))))
    # Only lengths taken in part are ranked: cells in order, then the rows of the cell that the budget ends in.
    cells = rows.where("cell is not null").groupBy(*key, "cell").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).withColumnsRenamed({k: f"c_{k}" for k in (*key, "cell")})
    out = rows.join(cells, rows.source.eqNullSafe(F.col("c_source")) & (rows.size == F.col("c_size")) & (rows.cell == F.col("c_cell")), "left").drop("c_source", "c_size", "c_cell")
    ends = (F.col("before") < F.col("extra")) & (F.col("before") + F.col("held") > F.col("extra"))
    ranked = out.where(ends).withColumn("rank", F.row_number().over(Window.partitionBy(*key, "cell").orderBy("mark", "doc_id", "no")))
    ranked = ranked.withColumn("once", (F.col("rank") + F.col("before") <= F.col("extra")).cast("long")).drop("rank")
    rest = out.where(~F.coalesce(ends, F.lit(False))).withColumn("once", F.when(F.col("cell").isNull(), (F.col("extra") > 0).cast("long")).otherwise((F.col("before") < F.col("extra")).cast("long")))
    both = ranked.unionByName(rest)
    return both.select("no", "doc_id", "size", "source", "source_size", "target", "mark", F.when(F.col("size") > 0, F.col("whole") + F.col("once")).otherwise(0).alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(no, doc_id, size, source, source_size, target, mark, times): how often the mix takes each row."""
    return selection(numbered(docs, id_col, text_col, source_col, seed, {}, hot))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, hot: int = HOT) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken; columns may have any names."""
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    rows = numbered(docs, id_col, text_col, source_col, seed, names, hot)
    taken = selection(rows).where("times > 0").select("no", "times")
    out = rows.select("no", *names).join(taken, "no")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*(F.col(n).alias(c) for n, c in names.items()))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
