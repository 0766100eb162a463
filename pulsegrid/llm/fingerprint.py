"""Threshold-scaled document fingerprints, in DataFrame functions only.

A sketch holds every 5-word shingle hash below a fixed fraction of the hash
range, 2**-scale, so its size follows the text's, the union of two sketches is
the sketch of both texts, and the share of a small text's hashes found in a
large one's estimates containment without bias. A short text may have no hash
below the fraction. So that it is not without a fingerprint, its smallest hash
is kept in a field of its own, ``least``, which is empty wherever a hash is: it
takes no part in a union that has hashes, nor in containment.

Defined cases: a null text is empty; a text of fewer words than a shingle is one
shingle; a text without words has an empty fingerprint, alike (1) to another
empty one and to nothing else; of two texts without hashes below the fraction,
those with equal smallest hashes are alike (1), others not (0); of such a text
and one that has hashes, ``likeness`` is unknown (null), and the query says 0.
Words are lower-cased. Documents with a null id come last, those with equal ids
in the order of their texts, and equal rows in any. A text is one row, however
long: its hashes are one array. An empty table gives an empty one. Only the id
and text columns are read, under names of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import table, text_bytes_total

WORDS, SCALE = 5, 2
#: Bytes of text for each range of ids, and the most ranges: beyond that they hold more.
RANGE, MOST_RANGES = 16_000_000, 1 << 16


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """(hashes, least): the sorted shingle hashes below the fraction, and the smallest hash of a text that has none below it."""
    cut = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(cut, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        run = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words)))
        return F.when(F.size(h) > words, F.transform(F.sequence(F.lit(0), F.size(h) - words), run)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    def kept(s: Column) -> Column:
        low = F.filter(s, lambda h: F.shiftrightunsigned(h, 64 - scale) == 0)
        return F.struct(F.array_sort(F.array_distinct(low)).alias("hashes"), F.when(F.size(low) == 0, F.array_min(s)).alias("least"))

    # A value bound as a lambda's variable is computed once.
    bound = lambda value, f: F.transform(F.array(value), f)[0]
    return bound(F.coalesce(hashed, F.array().cast("array<bigint>")), lambda h: bound(shingles(h), kept))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together, whose shingles are those of both."""
    hashes = F.array_sort(F.array_union(a["hashes"], b["hashes"]))
    return F.struct(hashes.alias("hashes"), F.when(F.size(hashes) == 0, F.least(a["least"], b["least"])).alias("least"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a has no hash below the fraction."""
    return F.when(F.size(a["hashes"]) > 0, F.size(F.array_intersect(a["hashes"], b["hashes"])) / F.size(a["hashes"]))


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the smaller text in the other, 0 to 1; null where only one has hashes below the fraction, unless the other is empty."""
    n, m = F.size(a["hashes"]), F.size(b["hashes"])
    none = a["least"].eqNullSafe(b["least"]).cast("double")  # of texts without such hashes; the empty text has neither
    empty = ((n == 0) & a["least"].isNull()) | ((m == 0) & b["least"].isNull())
    return F.when((n == 0) & (m == 0), none).when(empty, 0.0).when((n > 0) & (m > 0), F.when(n <= m, containment(a, b)).otherwise(containment(b, a)))


def as_string(s: Column) -> Column:
    """Hex of the hashes, or of the smallest one after a mark."""
    hexed = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.when(s["least"].isNull(), F.array_join(F.transform(s["hashes"], hexed), "")).otherwise(F.concat(F.lit("least:"), hexed(s["least"])))


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next): each text with that of the next id, after the last that of the first.

    Ids are cut into ranges at their quantiles, which need only be even, not
    exact; a row finds its range by bisection of the bounds. Rows meet their
    next in the same range by a window, and the last of a range gets the first
    of the next range, of which there is one row for each range.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    ranges = min(MOST_RANGES, 16 + text_bytes_total(docs, "text") // RANGE)
    cuts = docs.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    docs = docs.withColumn("range", bisected(F.col("key"), sorted(set(cuts))))
    lows = docs.groupBy("range").agg(F.min("key").alias("low")).select("low")
    # lows is broadcast: a row of 16 bytes for each range, MOST_RANGES at most.
    first = docs.join(F.broadcast(lows), docs.key == lows.low).groupBy("range").agg(F.min("text").alias("first"))
    every = Window.orderBy("range")  # unpartitioned: a row for each range, MOST_RANGES at most
    ends = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = first.select("range", F.coalesce(F.lead("first").over(every), F.first("first").over(ends)).alias("after"))
    near = docs.withColumn("next", F.lead("text").over(Window.partitionBy("range").orderBy("key", "text")))
    return near.join(after, "range", "left").select("doc_id", "text", F.coalesce("next", "after").alias("next"))


def bisected(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below key, in as many steps as the logarithm of their number."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    known = F.array(*(F.lit(b) for b in bounds)).cast("array<bigint>")
    further = lambda at, step: F.when(F.get(known, at + step - 1) < key, at + step).otherwise(at)
    return F.aggregate(F.array(*(F.lit(x) for x in steps)), F.lit(0), further)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    docs = docs.withColumn("n_chars", n.cast("long")).withColumn("edited", F.expr("concat(substring(text, 1, length(text) - length(text) div 2), substring(next, 1, length(text) div 2))"))
    s = docs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("text")).alias("a"), sketch(F.col("edited")).alias("b"), sketch(F.col("next")).alias("c"))
    return s.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("a")).alias("fingerprint"), as_string(F.col("b")).alias("edited_fingerprint"), F.coalesce(likeness(F.col("a"), F.col("b")), F.lit(0.0)).alias("near_edited"), F.coalesce(likeness(F.col("a"), F.col("c")), F.lit(0.0)).alias("near_next"))
