"""Substring dedup: repeated word windows, prefiltered by a count-min sketch.

A window is ``size`` consecutive words of one document. A word goes if a
window that covers it also starts in a document with a smaller id. Documents get
row numbers and are dealt into chunks of some megabytes; all else works on
chunks, so that messages and answers are counted by chunks, not by documents:

1. Sketch. Each chunk hashes its windows. A hash names a range of the count-min
   sketch and a place in it, from which the counters of both rows follow. The
   chunk's own sketch is sparse, its sorted places; the merged sketch of a range
   adds up all chunks'. There are as many ranges as the windows need, each of a
   fixed size, so the sketch grows with the input and no task holds more than
   one range. A range answers each chunk with a bit for each place it sent: is
   the least of its counters two or more? Counters overestimate, so no repeated
   window is missed. Nothing passes through the driver.
2. Exact groups. Only windows with that bit are grouped, by 96 bits of two
   independent hashes: each chunk keeps the smallest document of each window,
   settles its own others at once, and sends one entry for each window of that
   document; a window that is everywhere has as many entries as there are
   chunks. The answers are places in the chunk, and a last pass cuts words out.

All three passes read one shuffle of the texts. Words are never compared after
hashing: among n windows, the chance that any two unlike ones share 96 bits is
about n**2 / 2**97, a quarter of a percent for the 2e13 windows of 100 TB.

Defined cases: a null text has no words; ids that are null come after all
others, and rows with equal ids never cut each other's words; repeated rows
give repeated rows; a text of any length is one row of one chunk, hashed in
pieces of words; an empty table gives an empty one. Of the input, only the id,
the text and the columns named in carry are read, under names of their own, so
that columns of any other name are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import deflate, inflate, materialise, table, text_bytes, text_bytes_total, words_of

SIZE = 13
#: Bytes of text that a chunk is meant to hold, and chunks that there are at least.
CHUNK, LEAST_CHUNKS = 8_000_000, 16
#: Windows that a range of the sketch and a group of the second pass are meant for.
GROUP = 3_000_000
#: Bits of a place in a range; a row has a counter for each four places, which are four or more for a window.
PLACE_BITS = 26
#: Bytes of text that are cut into words at once.
PIECE = 2_000_000
LAST = np.iinfo(np.int64).max

_rng = np.random.default_rng(13)
_MULT = (_rng.integers(0, 1 << 63, (2, 4096), np.uint64) << np.uint64(1)) | np.uint64(1)


def window_hashes(docs: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: number of the document, place of the first word among all words, and two 64-bit hashes."""
    lengths = np.array([len(w) for w in docs], np.int64)
    digest = xxhash.xxh3_128_digest
    flat = np.frombuffer(b"".join([digest(w) for words in docs for w in words]), np.uint64).reshape(-1, 2)
    n = len(flat) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    doc = np.repeat(np.arange(len(docs)), lengths)
    whole = np.arange(n) + size <= np.cumsum(lengths)[doc[:n]]
    h = np.zeros((2, n), np.uint64)
    for row in range(2):
        lane = np.ascontiguousarray(flat[:, row])
        for j in range(size):
            h[row] += lane[j : j + n] * _MULT[row, j]
        h[row] ^= h[row] >> np.uint64(32)
    return doc[:n][whole], np.flatnonzero(whole), h[0][whole], h[1][whole]


def pack_sorted(a: np.ndarray, kind=np.uint8) -> bytes:
    """Sorted uint32 numbers as differences of one byte (or two), larger differences apart."""
    most = np.iinfo(kind).max
    d = np.diff(a, prepend=np.uint32(0)).astype(np.uint32)
    return len(a).to_bytes(8, "little") + np.minimum(d, most).astype(kind).tobytes() + d[d >= most].tobytes()


def unpack_sorted(b: bytes, kind=np.uint8) -> np.ndarray:
    n, most = int.from_bytes(b[:8], "little"), np.iinfo(kind).max
    d = np.frombuffer(b, kind, n, 8).astype(np.uint32)
    d[d == most] = np.frombuffer(b, np.uint32, offset=8 + n * np.dtype(kind).itemsize)
    return np.cumsum(d, dtype=np.uint32)


def in_order(chunk: pa.Table) -> pa.Table:
    """The rows of a chunk by id and row number: each pass sees them in the same order."""
    return chunk.take(pa.array(np.lexsort((chunk.column("no").to_numpy(), chunk.column("doc").to_numpy()))))


def pieces(chunk: pa.Table) -> Iterator[tuple[int, list[list[bytes]]]]:
    """First row and words of so many texts that one piece holds some megabytes (a text is never cut)."""
    at, texts = 0, text_bytes(chunk, "t")
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held < PIECE):
            held += len(texts[to] or b"")
            to += 1
        yield at, [words_of(t) for t in texts[at:to]]
        at = to


def chunk_windows(chunk: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of a chunk in order: document, place among the chunk's words, and two hashes."""
    ids, base, found = chunk.column("doc").to_numpy(), 0, []
    for at, words in pieces(chunk):
        n, pos, a, b = window_hashes(words, size)
        found.append((ids[at + n], (base + pos).astype(np.uint32), a, b))
        base += sum(map(len, words))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, k) for k in (np.int64, np.uint32, np.uint64, np.uint64))


def sketch_keys(a: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Range and place of each window in one number."""
    part = ((a >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return part << np.uint64(bits) | a & np.uint64((1 << bits) - 1)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(sorted_values))[: len(starts)]


def counters(places: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each place in the two rows."""
    return places >> np.uint32(2), (places * np.uint32(0x9E3779B1)) >> np.uint32(34 - bits)


def estimated_repeats(stored: DataFrame, ranges: int, size: int, bits: int) -> DataFrame:
    """(chunk, range, bits): for each chunk, which of its windows, sorted by range and place, the sketch counts twice or more."""

    def own_sketch(key: tuple, chunk: pa.Table) -> pa.Table:
        keys = sketch_keys(chunk_windows(in_order(chunk), size)[2], ranges, bits)
        keys.sort()
        part = (keys >> np.uint64(bits)).astype(np.int64)
        places = (keys & np.uint64((1 << bits) - 1)).astype(np.uint32)
        starts, ends = runs(part)
        blobs = [pack_sorted(places[s:e], np.uint16) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.table({"range": part[starts], "chunk": pa.array([key[0].as_py()] * len(starts), pa.int64()), "sketch": pa.array(blobs, pa.binary())})

    def merged(sketches: pa.Table) -> pa.Table:
        rows = np.zeros((2, 1 << (bits - 2)), np.uint8)  # counters that stop at two
        blobs = sketches.column("sketch").to_pylist()
        for blob in blobs:
            for row, at in zip(rows, counters(unpack_sorted(blob, np.uint16), bits), strict=True):
                at = np.sort(at)
                again = np.concatenate([[False], at[1:] == at[:-1]])
                row[at[~again]] = np.minimum(row[at[~again]] + 1, 2)
                row[at[again]] = 2
        answers = []
        for blob in blobs:
            first, second = counters(unpack_sorted(blob, np.uint16), bits)
            answers.append(np.packbits(np.minimum(rows[0][first], rows[1][second]) >= 2).tobytes())
        return pa.table({"chunk": sketches.column("chunk"), "range": sketches.column("range"), "bits": pa.array(answers, pa.binary())})

    sketches = stored.groupBy("chunk").applyInArrow(own_sketch, "range long, chunk long, sketch binary")
    return sketches.groupBy("range").applyInArrow(merged, "chunk long, range long, bits binary")


def removed_windows(stored: DataFrame, repeats: DataFrame, groups: int, size: int, bits: int) -> DataFrame:
    """(chunk, at): packed places of windows that start in a document of a smaller id too."""
    fields = ["a", "b", "doc", "at", "cut"]
    none = pa.scalar(None, pa.binary())

    def ask(key: tuple, chunk: pa.Table, estimates: pa.Table) -> pa.Table:
        doc, at, a, b = chunk_windows(in_order(chunk), size)
        keys = sketch_keys(a, groups, bits)
        order = np.argsort(keys, kind="stable")
        starts, ends = runs(keys[order] >> np.uint64(bits))
        answers = estimates.column("bits").take(pa.array(np.argsort(estimates.column("range").to_numpy()))).to_pylist()
        may = np.zeros(len(a), bool)
        for s, e, own in zip(starts.tolist(), ends.tolist(), answers, strict=True):
            may[order[s:e]] = np.unpackbits(np.frombuffer(own, np.uint8), count=e - s).astype(bool)
        doc, at, a, b = (x[may] for x in (doc, at, a, b))
        order = np.lexsort((doc, b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(a)), 0)) if len(a) else order
        later = np.zeros(len(a), bool)
        later[order] = doc[order] > doc[order[first]]
        cut = at[later]
        doc, at, a, b = (x[~later] for x in (doc, at, a, b))
        shard = (b % np.uint64(groups)).astype(np.int64)
        order = np.argsort(shard, kind="stable")  # within a shard in the order of the text, where ids and places pack well
        starts, ends = runs(shard[order])
        parts = [order[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        columns = [[a[p].tobytes(), b[p].astype(np.uint32).tobytes(), deflate(np.diff(doc[p], prepend=0)), deflate(np.diff(at[p], prepend=0).astype(np.int32)), none] for p in parts]
        to = shard[order[starts]].tolist()
        if len(cut):
            columns.append([none] * 4 + [pack_sorted(cut)])
            to.append(key[0].as_py() % groups)
        columns = list(zip(*columns, strict=True)) or [[]] * len(fields)
        return pa.table({"shard": pa.array(to, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(to), pa.int64())} | {f: pa.array([None if x is none else x for x in c], pa.binary()) for f, c in zip(fields, columns, strict=True)})

    def answer(messages: pa.Table) -> pa.Table:
        settled = messages.filter(messages.column("cut").is_valid())
        asked = messages.filter(messages.column("cut").is_null())
        a, b = (np.concatenate([np.zeros(0, k), *(np.frombuffer(x, k) for x in asked.column(f).to_pylist())]) for f, k in (("a", np.uint64), ("b", np.uint32)))
        places = [np.cumsum(inflate(x, np.int32), dtype=np.int64).astype(np.uint32) for x in asked.column("at").to_pylist()]
        doc = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(inflate(x, np.int64)) for x in asked.column("doc").to_pylist())])
        order = np.lexsort((doc, b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(a)), 0)) if len(a) else order
        later = np.zeros(len(a), bool)
        later[order] = doc[order] > doc[order[first]]
        chunks, cuts, base = settled.column("chunk").to_pylist(), settled.column("cut").to_pylist(), 0
        for chunk, at in zip(asked.column("chunk").to_pylist(), places, strict=True):
            cut = at[later[base : base + len(at)]]
            base += len(at)
            if len(cut):
                chunks.append(chunk)
                cuts.append(pack_sorted(cut))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "at": pa.array(cuts, pa.binary())})

    schema = "shard long, chunk long, " + ", ".join(f"{f} binary" for f in fields)
    asked = stored.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(ask, schema)
    return asked.groupBy("shard").applyInArrow(answer, "chunk long, at binary")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, carry: tuple[str, ...] = (), chunk: int = CHUNK, group: int = GROUP, bits: int = PLACE_BITS) -> DataFrame:
    """(doc_id, text, n_words, n_removed) and the columns named in carry: texts without repeated windows, kept words joined by one space; a null text gives an empty one."""
    names = [f"c{j}" for j in range(len(carry))]
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), *(F.col(c).alias(n) for n, c in zip(names, carry, strict=True)))
    size_of_all = text_bytes_total(docs, "t")
    chunks, groups = LEAST_CHUNKS + size_of_all // chunk, 12 + size_of_all // 5 // group
    # The table fixes the row numbers, so that a task that runs again finds the same chunks.
    stored = materialise(docs.withColumns({"doc": F.coalesce("id", F.lit(LAST)), "no": F.monotonically_increasing_id()}))
    stored = stored.withColumn("chunk", F.pmod(F.xxhash64("no"), F.lit(chunks)))
    cuts = removed_windows(stored, estimated_repeats(stored, groups, size, bits), groups, size, bits)

    def cut(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, base = in_order(chunk), 0
        starts = np.sort(np.concatenate([np.zeros(0, np.uint32), *(unpack_sorted(x) for x in answers.column("at").to_pylist())])).astype(np.int64)
        texts, counts, gone = [], [], []
        for _, docs in pieces(chunk):
            flat = sum(map(len, docs))
            own = starts[slice(*np.searchsorted(starts, [base, base + flat]))] - base
            edge = np.bincount(own, minlength=flat + 1) - np.bincount(own + size, minlength=flat + 1)  # windows end within their document
            keep, at = np.cumsum(edge[:-1]) == 0, 0
            for words in docs:
                kept = keep[at : at + len(words)]
                n = int(kept.sum())
                texts.append(b" ".join(words if n == len(words) else [w for w, k in zip(words, kept.tolist(), strict=True) if k]))
                counts.append(len(words))
                gone.append(len(words) - n)
                at += len(words)
            base += flat
        return pa.table({"doc_id": chunk.column("id"), "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64())} | {n: chunk.column(n) for n in names})

    kinds = [("doc_id", T.LongType()), ("text", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), *((n, docs.schema[n].dataType) for n in names)]
    out = stored.groupBy("chunk").cogroup(cuts.groupBy("chunk")).applyInArrow(cut, T.StructType([T.StructField(*k) for k in kinds]))
    return out.withColumnsRenamed(dict(zip(names, carry, strict=True)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
