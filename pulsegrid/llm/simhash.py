"""SimHash near-duplicates, found by meet-in-the-middle ball hashing, which a prefix join completes for a similarity threshold.

Two fingerprints within r bits share a variant within r/2 bits of both. So
each distinct fingerprint emits all its variants within r/2 bits, one shuffle
brings equal variants together, and every pair met there is checked.

Two forms:

* ``simhash_components``: one 64-bit fingerprint, linked at ``radius`` bits.
  A variant is shared by at most as many distinct fingerprints as a ball of
  radius r/2 has points (65 for r = 2), so no group grows with the data.
* ``near_duplicate_groups``: for a similarity threshold, exact. Balls of the
  fingerprints of shingle sets bring near-identical texts together first. But at
  a Jaccard of 0.8 about 10 of 64 bits differ: balls of 5 bits have millions of
  points, and short blocks of longer fingerprints lose pairs. So what balls of
  one bit can't reach is found by a join of prefixes. Shingles have one order
  for all texts, those often found in a sample last. Two sets of a Jaccard of t
  or more share a shingle among the first n - ceil(t n) + 1 of each, so each
  distinct set is posted under these, and sets that meet under a shingle are
  compared unless their sizes or places rule a Jaccard of t out, or they are
  already in one component: where they meet, by parities of a few bytes that come
  with each posting, so that few pairs of a bucket of unlike sets are ever rows;
  then by longer parities, once for each pair; then by their texts. Parities rule
  out most unlike pairs and no others. That is done in rounds: each pairs a set
  with a bounded number of the others of its bucket, the first in some of the
  buckets only; components grow by what was verified, buckets that have nothing
  left to compare go, and the last round leaves no two components of a bucket
  uncompared.
  No pair is joined unverified. The sample decides the order alone: how many
  pairs meet, never which are found.

Defined cases: null and empty texts have fingerprint zero and link with each
other (``near_duplicate_groups`` leaves them alone); fewer words than a shingle
give one shingle of all words; equal texts have equal fingerprints; repeated
rows stay repeated; a null id is never the smallest while its group has
another. A text of any length is hashed whole, its bits counted in pieces. An
empty table gives an empty one. Only the id and text columns are read, under
names of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cleaned, connected_components, discard, map_batches, materialise, remove, table, tables_dir, text_bytes, words_of

SEED = 42
SIMILAR = 0.8
#: The shingles that come last in the order: at most so many, found in OFTEN documents or more of a sample of one in SAMPLE (all, if under SAMPLE_ROWS).
LAST, OFTEN, SAMPLE, SAMPLE_ROWS = 1 << 17, 3, 16, 20_000
#: Documents for each part of the postings: bounds what one task holds.
PART_ROWS = 4_000
#: Others of a bucket that a set is paired with in the first round, and how the number grows.
FIRST, GROWTH = 2, 32
#: The first round takes one part in so many: alike sets share many shingles, and each that finds a pair again makes a row.
SOME = 8
#: Bytes of the parity that comes with each posting, at most: a power of two.
FEW = 128


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined k-word shingles, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return np.fromiter((h(s, SEED) for s in runs), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the rows of hashes (n x uint64 lanes): is it set in over half of them?"""
    n, lanes = hashes.shape
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, n, 1 << 14):  # long texts in pieces, so memory stays small
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)]).view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return ones * 2 > n


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each row's lower-cased words, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            for i, t in enumerate(text_bytes(b, "t")):
                h = shingle_hashes(words_of(t and t.lower()), shingle)
                if len(h):
                    out[i] = np.packbits(majority(h.reshape(-1, 1)), bitorder="little").view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """All masks of so many bits with at most radius ones, as signed longs."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b) of distinct fingerprints fp that share a variant and differ in radius or fewer bits; the least of each variant's links with all others."""
    masks = F.array(*(F.lit(m) for m in ball(64, radius // 2)))
    # Dealt out again, by another expression than before: distinct fingerprints are few bytes, which Spark would leave to a few tasks, but each makes a ball of variants.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    sent = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = sent.groupBy("variant").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)
    return met.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, radius))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints, and the smallest id reachable by links of radius or fewer bits."""
    if radius % 2:
        raise ValueError("radius must be even: it is met halfway")
    fps = materialise(fingerprints(docs, id_col, text_col, shingle))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    links = ball_links(distinct.select("fp"), radius)
    comp = connected_components(links)
    rooted = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted)
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(rooted.join(low, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def distinct_shingles(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(text and text.lower()), shingle))


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each remainder of distinct hashes, by a power of two of twice their number or more: do an odd number of them have it?"""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(x: bytes, length: int) -> bytes:
    """A parity of so many bytes from one of as many or more: by the remainders of fewer bits."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, length), axis=0).tobytes() if len(x) > length else x


def apart(x: bytes, y: bytes) -> int:
    """How many hashes, at least, are in one of two sets only, by their parities: each changes one bit. The longer one is folded to the remainders of the shorter."""
    a, b = (np.frombuffer(folded(p, min(len(x), len(y))), np.uint8) for p in (x, y))
    return int(np.bitwise_count(a ^ b).sum())


class Parities:
    """Many parities of at most FEW bytes, to compare pairs of them at once."""

    def __init__(self, parities: list[bytes]):
        self.lengths = np.array([len(x) for x in parities], np.int64)
        self.folds: dict[int, np.ndarray] = {}
        for length in sorted(set(self.lengths.tolist()), reverse=True):
            # Only those of that length or more are ever compared at it.
            self.folds[length] = np.frombuffer(b"".join(folded(x, length) if len(x) >= length else bytes(length) for x in parities), np.uint64).reshape(-1, length // 8)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """apart of the pairs of the places x and y."""
        out, length = np.zeros(len(x), np.int64), np.minimum(self.lengths[x], self.lengths[y])
        for n, fold in self.folds.items():
            (rows,) = np.nonzero(length == n)
            for at in range(0, len(rows), 1 << 16):  # in pieces, so memory stays small
                some = rows[at : at + (1 << 16)]
                out[some] = np.bitwise_count(fold[x[some]] ^ fold[y[some]]).sum(axis=1, dtype=np.int64)
        return out


def often(docs: DataFrame, documents: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of shingles that many documents of a sample have, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.concatenate([np.zeros(0, np.uint64), *(distinct_shingles(t, shingle) for t in text_bytes(b, "t"))])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    share = max(1, min(SAMPLE, documents // SAMPLE_ROWS))
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("t")
    kept = materialise(map_batches(some, run, "h long").groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(LAST), clean=True)
    got = kept.toArrow()
    discard(kept)
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(docs: DataFrame, shingle: int, least: float, last: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, node, fp, n, bits, few, prefix): a hash and the fingerprint of the shingle set, its size, its parity, whole and of FEW bytes at most, and its first shingles; rows without words are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shared.value
        for b in batches:
            ids, nodes, prints, sizes, bits, few, firsts = [], [], [], [], [], [], []
            for i, t in enumerate(text_bytes(b, "t")):
                h = distinct_shingles(t, shingle)
                if len(h):
                    rank = np.zeros(len(h), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        rank = np.where(known[at] == h, times[at], 0)
                    length = len(h) - ceil(least * len(h) - 1e-9) + 1
                    ids.append(i)
                    nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                    prints.append(np.packbits(majority(h.reshape(-1, 1)), bitorder="little").view(np.int64)[0])
                    sizes.append(len(h))
                    bits.append(parity(h))
                    few.append(folded(bits[-1], FEW))
                    firsts.append(h[np.argsort(rank, kind="stable")[:length]].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ids, pa.int64())), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(few, pa.binary()), pa.array(firsts, pa.binary())], ["doc_id", "node", "fp", "n", "bits", "few", "prefix"])

    return map_batches(docs, run, "doc_id long, node long, fp long, n int, bits binary, few binary, prefix binary")


def postings(sets: DataFrame, parts: int) -> DataFrame:
    """(part, h, node, n, at) for each shingle h of a prefix that has another set's posting; at is its place."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            firsts = b.column("prefix").to_pylist()
            h, lengths = np.frombuffer(b"".join(firsts), np.uint64), np.array([len(x) // 8 for x in firsts], np.int64)
            node, n = (np.repeat(b.column(c).to_numpy(), lengths) for c in ("node", "n"))
            at = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(parts)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(node), pa.array(n), pa.array(at.astype(np.int32))], ["part", "h", "node", "n", "at"])

    def met(rows: pa.Table) -> pa.Table:
        _, back, count = np.unique(rows.column("h").to_numpy(), return_inverse=True, return_counts=True)
        return rows.filter(pa.array(count[back] > 1))

    schema = "part int, h long, node long, n int, at int"
    return map_batches(sets.select("node", "n", "prefix"), spread, schema).groupBy("part").applyInArrow(met, schema)


def open_buckets(rooted: DataFrame, done: int) -> DataFrame:
    """The postings of buckets of two roots or more, without buckets where each set was paired with as many others as done, as all their pairs are known."""

    def run(rows: pa.Table) -> pa.Table:
        h, root = (rows.column(c).to_numpy() for c in ("h", "root"))
        order = np.lexsort((root, h))
        h, root = h[order], root[order]
        (first,) = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        keep = (root[first] != root[first + size - 1]) & (size > done + 1)
        return rows.take(pa.array(order[np.repeat(keep, size)]))

    return rooted.groupBy("part").applyInArrow(run, "part int, h long, node long, n int, at int, root long")


def candidates(posted: DataFrame, least: float, most: int) -> DataFrame:
    """(a, b) of sets of different roots that meet and may be alike, each with at most so many of its bucket; a row (0, 0) if that left any out."""

    def run(rows: pa.Table) -> pa.Table:
        h, root, node, n, at = (rows.column(c).to_numpy() for c in ("h", "root", "node", "n", "at"))
        order = np.lexsort((node, root, h))
        h, root, node, n, at = (c[order] for c in (h, root, node, n, at))
        bits = Parities(rows.column("few").take(pa.array(order)).to_pylist())
        here = np.arange(len(h))
        new = np.concatenate([[True], h[1:] != h[:-1]])
        bucket = np.maximum.accumulate(np.where(new, here, 0))
        own = np.maximum.accumulate(np.where(new | np.concatenate([[True], root[1:] != root[:-1]]), here, 0))
        others = own - bucket
        take = np.minimum(others, most)
        ends, found = np.cumsum(take), [np.zeros((0, 2), np.int64)]
        low = 0
        while low < len(h):  # so many rows that their pairs fit in memory, one at least
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 20), "right")))
            y = np.repeat(here[low:high], take[low:high])
            nth = np.arange(len(y)) - np.repeat(ends[low:high] - take[low:high] - (ends[low - 1] if low else 0), take[low:high])
            x = bucket[y] + nth * others[y] // take[y]
            need = np.ceil(least / (1 + least) * (n[x].astype(np.int64) + n[y]) - 1e-6)
            ok = np.minimum(at[x], at[y]) + 1 + np.minimum(n[x] - at[x], n[y] - at[y]) - 1 >= need
            ok &= np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - 1e-6
            x, y = x[ok], y[ok]
            ok = bits.apart(x, y) <= (n[x].astype(np.int64) + n[y]) * ((1 - least) / (1 + least)) + 1e-6
            x, y = node[x[ok]], node[y[ok]]
            found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
            low = high
        if (others > most).any():
            found.append(np.zeros((1, 2), np.int64))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return posted.groupBy("part").applyInArrow(run, "a long, b long").distinct()


def bucketed(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """A table of df's rows in the shared folder, dealt out by key: joins by it read the table without a shuffle. For a frame that is dealt out so already."""
    spark, name = df.sparkSession, f"near_{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.option("path", f"{tables_dir(spark)}/{name}").option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    out = spark.table(name)
    out.table_name = name
    return out


def drop(df: DataFrame) -> None:
    """Removes a table that bucketed returned."""
    df.sparkSession.sql(f"DROP TABLE {df.table_name}")
    remove(df.sparkSession, f"{tables_dir(df.sparkSession)}/{df.table_name}")


def possible(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, ia, ib): the pairs whose sizes and whole parities don't rule a Jaccard of least out, and the ids of rows that have their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (b.column("na").to_numpy().astype(np.int64) + b.column("nb").to_numpy()) * ((1 - least) / (1 + least)) + 1e-6
            keep = [apart(x, y) <= m for x, y, m in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist(), most, strict=True)]
            yield b.select(["a", "b", "ia", "ib"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: sets.select(F.col("node").alias(c), F.col("id").alias(f"i{c}"), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    return map_batches(pairs.join(of("a"), "a").join(of("b"), "b"), run, "a long, b long, ia long, ib long")


def packed(docs: DataFrame) -> DataFrame:
    """(id, size, t): texts as bytes under zstd, and their sizes, since Spark's shuffles hold them at well over that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            texts = [t or b"" for t in text_bytes(b, "t")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())], ["id", "size", "t"])

    return map_batches(docs, run, "id long, size long, t binary")


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b) of the possible pairs whose texts' shingle sets have a Jaccard of least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        codec = pa.Codec("zstd")

        def of(node: int, size: int, text: bytes) -> np.ndarray | None:
            """The set of a node; none of a text that shares its id but has another set."""
            if node not in known:
                got = distinct_shingles(codec.decompress(text, size, asbytes=True) if size else b"", shingle)
                if xxhash.xxh64_intdigest(got.tobytes(), SEED) != node % (1 << 64):
                    return None
                known[node] = got
            return known[node]

        for b in batches:
            keep = []
            for x, nx, tx, y, ny, ty in zip(*(b.column(c).to_pylist() for c in ("a", "na", "ta", "b", "nb", "tb")), strict=True):
                x, y = of(x, nx, tx), of(y, ny, ty)
                both = 0 if x is None or y is None else len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both + 1e-9 >= least * (len(x) + len(y) - both))
            known.clear()
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: texts.select(F.col("id").alias(f"i{c}"), F.col("size").alias(f"n{c}"), F.col("t").alias(f"t{c}"))
    got = pairs.join(of("a"), "ia").join(of("b"), "ib")
    return map_batches(got.select("a", "na", "ta", "b", "nb", "tb"), run, "a long, b long")


def near_identical(made: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): sets whose fingerprints are equal or share a ball, not yet verified."""
    nodes = made.select("node", "fp").distinct()
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    equal = nodes.join(first, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}"))
    return equal.union(ball_links(first.select("fp"), radius).distinct().join(of("a"), "a").join(of("b"), "b").select("na", "nb"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = SIMILAR, first: int = FIRST) -> DataFrame:
    """(doc_id, group_id) of rows that have another row of a similarity of least or more; group_id is the smallest id of the group.

    Ids should be distinct: rows that share one are one document. Rows with a
    null id are left out.
    """
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    documents = docs.count()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + documents // PART_ROWS)
    tables = []

    def keep(df: DataFrame) -> DataFrame:
        tables.append(materialise(df, clean=True))
        return tables[-1]

    whole = materialise(prefixes(docs, shingle, least, often(docs, documents, shingle)), clean=True)
    distinct = whole.groupBy("node").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("x")).select("node", "x.*")
    parts = 1 + documents // PART_ROWS
    posted = keep(postings(distinct, parts))
    made = keep(whole.select("doc_id", "node", "fp", "n"))
    ids = whole.groupBy("node").agg(F.min(F.struct(F.col("doc_id").alias("id"), "n", "bits", "few")).alias("x"))
    sets = bucketed(ids.join(posted.select("node").distinct(), "node", "left_semi").select("node", "x.*").repartition(buckets, "node"), buckets, "node")
    discard(whole)
    # One shuffle of the texts: those that met stay where they were dealt out to.
    texts = bucketed(packed(docs).repartition(buckets, "id").join(sets.select("id").distinct(), "id", "left_semi"), buckets, "id")
    # Rows that share an id are one document.
    links = keep(made.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("all")).where("a != b").select("a", F.explode("all").alias("b")))

    def verified(pairs: DataFrame) -> DataFrame:
        return similar(keep(possible(pairs, sets, least)), texts, shingle, least)

    links = keep(links.union(verified(near_identical(made))))
    most, seen, done = first, None, 0
    while True:
        comp = keep(connected_components(links))
        rooted = posted.join(comp, "node", "left").select("part", "h", "node", "n", "at", F.coalesce("root", "node").alias("root"))
        whole_round = seen is not None or parts == 1
        left = open_buckets(rooted if whole_round else rooted.where(F.col("part") % SOME == 0), done)
        found = candidates(left.join(sets.select("node", "few"), "node"), least, most)
        pairs = keep(found if seen is None else found.join(seen, ["a", "b"], "left_anti"))
        seen = pairs.where("a != b") if seen is None else seen.union(pairs.where("a != b"))
        links = keep(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(pairs.where("a != b"))))
        if whole_round and pairs.where("a = b").isEmpty():
            break
        done, most = most if whole_round else 0, most * GROWTH
    comp = connected_components(links)
    of = made.select("doc_id", "node").join(comp, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")).distinct()
    lows = of.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).where("n > 1").select("root", "group_id")
    groups = materialise(of.join(lows, "root").select("doc_id", "group_id"), clean=True)
    for t in (sets, texts):
        drop(t)
    for t in tables:
        discard(t)
    return groups


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
