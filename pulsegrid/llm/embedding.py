"""Embedding near-duplicates by a pivot-permutation index.

A bounded sample of vectors serves as reference points (pivots); of pivots that
would link with each other one is kept, so a dense group has few of its own. A
vector is described by its NEAR nearest pivots in order. It is posted under each
of them: an inverted list holds the vectors of a label that have its pivot.

Two vectors of a list are candidates if they share SHARED pivots or more, which
is counted from the descriptions alone; candidates are verified by cosine. A
pair meets in as many lists as it shares pivots, and counts in that of the
first. Shared pivots are counted by a product of membership matrices where a
list has few other pivots (as in a dense group), and through the lists within
the list where it has many. Lists above BLOCK are cut into blocks, every two of
which make a group, so that no group exceeds two blocks, and none is left out.
Groups send back link counts and a star of links for each component in them,
never pairs.

Links are true ones, but a pair that shares fewer pivots is missed: recall is
measured in tests against brute force (0.99 or more for cosines of 0.93 to 0.96
in 64 dimensions, from 128 to 2048 pivots, and with a third of the rows as near
copies of one vector). The sample is one vector in ROWS_PER_PIVOT up to
MOST_PIVOTS; while it grows with the rows, lists don't. Beyond 2 million
vectors of one label lists grow with them.

Equal vectors of a label are indexed once and weigh as many as they are.

Defined cases: vectors that are null, empty or zero, or that hold null or
non-finite components, and those with a null label, link with nothing and are
their own component; vectors of different length never link; the pivots are
those of the most frequent length, vectors of other lengths are compared with
pivots cut or padded by zeros. Repeated ids: one row each, linked as any two. An
empty table gives an empty one. Only the three columns named are read, under
names of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import connected_components, map_batches, materialise, table

COSINE = 0.93
#: Pivots: a sample of one distinct vector in ROWS_PER_PIVOT, within bounds.
LEAST_PIVOTS, MOST_PIVOTS, ROWS_PER_PIVOT = 128, 16_384, 128
#: Pivots that describe a vector, and that candidates share at least.
NEAR, SHARED = 10, 2
#: Vectors of a list that one block holds, and rows that are compared at once.
BLOCK, SLICE = 4_000, 512


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v, ok): ok if the vector can link."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(sound & F.col(label_col).isNotNull(), F.lit(False)).alias("ok"))


def pivots_of(rows: DataFrame, count: int, cosine: float) -> np.ndarray:
    """The vectors of the lowest seeded hashes, scaled to length one; without those that would link with one before."""
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return np.zeros((0, 1))
    got = rows.where(F.size("v") == size["n"]).orderBy(F.xxhash64(F.lit(5), "v"), "v").select("v").limit(count).collect()
    p = scaled(np.array([r["v"] for r in got], np.float64))
    kept = np.zeros((0, p.shape[1]))
    for s in range(0, len(p), SLICE):
        part = p[s : s + SLICE]
        part = part[(part @ kept.T >= cosine).sum(axis=1) == 0]
        like, own = part @ part.T >= cosine, []
        for i in range(len(part)):
            if not like[i, own].any():
                own.append(i)
        kept = np.concatenate([kept, part[own]])
    return kept


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled twice, so that very large or small components don't overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def roots(low: np.ndarray) -> np.ndarray:
    while (low[low] != low).any():
        low[:] = low[low]
    return low


def join(low: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Hangs roots under lower roots until no pair has two."""
    while len(p):
        x, y = roots(low)[p], low[q]
        p, q, x, y = (c[x != y] for c in (p, q, x, y))
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))


def shared_pairs(pivot: int, perms: np.ndarray, a: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x of a, y of c) that share SHARED pivots or more, of which pivot is the lowest; x before y where a is c."""
    within = len(a) == len(c) and (a == c).all()
    local, at = np.unique(perms, return_inverse=True)
    at = at.reshape(perms.shape)
    held = np.zeros((2, len(local)), np.int64)
    for row, part in zip(held, (a, c), strict=True):
        np.add.at(row, at[part].ravel(), 1)
    others = local != pivot
    # Nanoseconds, roughly: a product for each pair and local pivot, or the pairs of each list in this list.
    if 0.2 * len(a) * len(c) * len(local) <= 100 * float((held[0] * held[1])[others].sum()):
        member = np.zeros((len(perms), len(local)), np.float32)
        member[np.arange(len(perms))[:, None], at] = 1
        weighed = member * np.where(local < pivot, 1000, 1).astype(np.float32)
        for s in range(0, len(a), SLICE):
            count = weighed[a[s : s + SLICE]] @ member[c].T
            x, y = np.nonzero((count >= SHARED) & (count < 1000))
            x, y = a[s + x], c[y]
            yield (x[x < y], y[x < y]) if within else (x, y)
        return
    width, none, size = perms.shape[1], np.iinfo(np.int64).max, 0
    order = [np.argsort(at[part].ravel(), kind="stable") for part in (a, c)]
    starts = [np.concatenate([[0], np.cumsum(h)]) for h in held]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def counted() -> tuple[np.ndarray, np.ndarray]:
        """The pairs of which pivot is the first shared one and the list they were found in the second, so none comes twice."""
        x, y, second = (np.concatenate(z) for z in zip(*found, strict=True))
        same = (perms[x][:, :, None] == perms[y][:, None, :]).any(axis=2) & (perms[x] >= 0)
        low = np.sort(np.where(same, perms[x], none), axis=1)
        keep = (low[:, 0] == pivot) & (low[:, 1] == second) & (same.sum(axis=1) >= SHARED)
        return x[keep], y[keep]

    for q in np.flatnonzero((local > pivot) & (held[0] > 0) & (held[1] > 0)):
        x, y = (part[o[z[q] : z[q + 1]] // width] for part, o, z in zip((a, c), order, starts, strict=True))
        step = max(1, (1 << 18) // len(y))
        for s in range(0, len(x), step):
            u, w = np.repeat(x[s : s + step], len(y)), np.tile(y, len(x[s : s + step]))
            if within:
                u, w = u[u < w], w[u < w]
            found.append((u, w, np.full(len(u), local[q])))
            size += len(u)
            if size > 1 << 18:
                yield counted()
                found, size = [], 0
    if found:
        yield counted()


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    rows = unit_rows(vectors, id_col, vector_col, label_col)
    numbered = rows.where("ok").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    distinct = materialise(numbered.select(F.monotonically_increasing_id().alias("rep"), "label", "v", "copies", "low"))  # the table fixes the numbers
    n = distinct.count()
    points = spark.sparkContext.broadcast(pivots_of(distinct, pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, n // ROWS_PER_PIVOT)), cosine))  # MOST_PIVOTS at most

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = points.value
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE):
                b = whole.slice(s, SLICE)
                flat, at = b.column("v").flatten().to_numpy(), np.concatenate([[0], np.cumsum(b.column("v").value_lengths().to_numpy())])
                sizes = np.diff(at)
                like = np.zeros((b.num_rows, len(p)))
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    both = min(size, p.shape[1])
                    like[own] = scaled(np.stack([flat[at[i] : at[i + 1]] for i in own]))[:, :both] @ p[:, :both].T
                near = np.argpartition(-like, NEAR, axis=1)[:, :NEAR] if len(p) > NEAR else np.tile(np.arange(len(p)), (b.num_rows, 1))
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(like, near, axis=1), axis=1, kind="stable"), axis=1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "label", "v", "copies")), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], ["rep", "label", "v", "copies", "perm"])

    described = materialise(map_batches(distinct.select("rep", "label", "v", "copies"), describe, "rep long, label string, v array<double>, copies long, perm array<int>"))
    posted = described.select("label", F.explode("perm").alias("pivot"), "rep", "v", "copies", "perm")
    long = described.select("label", F.explode("perm").alias("pivot")).groupBy("label", "pivot").count().where(F.col("count") > block).select("label", "pivot", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    posted = posted.join(long, ["label", "pivot"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("label", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "v", "copies", "perm")

    def judge(key: tuple, rows: pa.Table) -> pa.Table:
        _, pivot, i, j = (x.as_py() for x in key)
        own, rep, copies = (rows.column(c).to_numpy() for c in ("own", "rep", "copies"))
        perms = rows.column("perm").combine_chunks().flatten().to_numpy().reshape(len(rep), -1).astype(np.int64)
        every = rows.column("v").combine_chunks()
        sizes = every.value_lengths().to_numpy()
        flat, at = every.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        links, low = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for size in np.unique(sizes):
            of = np.flatnonzero(sizes == size)
            a, c = of[own[of] == i], of[own[of] == j]
            if not len(a) or not len(c):
                continue
            v = np.zeros((len(rep), size))
            v[of] = scaled(np.stack([flat[at[x] : at[x + 1]] for x in of]))
            for x, y in shared_pairs(pivot, perms, a, c):
                if not len(x):
                    continue
                left, right = np.unique(x), np.unique(y)
                if len(x) * 20 > len(left) * len(right):  # most of a block: one product
                    like = (v[left] @ v[right].T)[np.searchsorted(left, x), np.searchsorted(right, y)]
                else:
                    like = np.concatenate([np.einsum("ij,ij->i", v[x[s : s + 20_000]], v[y[s : s + 20_000]]) for s in range(0, len(x), 20_000)])
                x, y = x[like >= cosine], y[like >= cosine]
                links += np.bincount(x, copies[y], len(rep)).astype(np.int64) + np.bincount(y, copies[x], len(rep)).astype(np.int64)
                join(low, x, y)
        root = roots(low)
        keep = (links > 0) | (root != np.arange(len(rep)))
        return pa.table({"rep": rep[keep], "links": links[keep], "root": rep[root[keep]]})

    judged = materialise(posted.groupBy("label", "pivot", "i", "j").applyInArrow(judge, "rep long, links long, root long"))
    counts = judged.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(judged.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of = distinct.join(counts, "rep", "left").join(comp, distinct.rep == comp.node, "left").select("label", "v", "copies", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root"))
    of = materialise(of)
    lows = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.join(lows, "root").select("label", "v", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    marked = rows.select("vec_id", F.when(F.col("ok"), F.col("label")).alias("label"), "v")
    out = marked.join(of, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
