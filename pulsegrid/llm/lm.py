"""Language-model scores: prediction by partial matching over bytes, beside a word baseline.

Model: the counts of all runs of six bytes in the training texts, a start mark
before and an end mark after each; shorter contexts are sums of these. A level of the trie holds the
contexts of one length. A byte is predicted from its longest known context; if
unseen there, the context's escape is paid and the next shorter one is asked
without the bytes that the longer one knew (symbol exclusion), down to equal
chances for bytes never seen. Every byte seen after a context gives half a count to the
escape.

The model is whole and stays distributed: it is cut into parts by the last two
bytes of contexts, frequent pairs by a third, and each part works out the cost of every run that any text
has. Broadcast is only a cache: the costs of the most frequent runs, at most
``runs``. All other runs are looked up by a shuffle, as rare words are, so scores do not
depend on ``runs``.

Word baseline: hot words, at most ``hot`` by the threshold's arithmetic, are
broadcast with their counts; all other words are looked up by a shuffle of packed
messages, each task's words of a shard in one; a shard answers with sums by
document. A rare word has fewer occurrences than the threshold, so no shard
grows with one word.

Defined cases: a null text is empty: one end token, and the model's end mark
after the start. A null id counts as empty text in the fold, so it is held out.
Repeated rows are scored each. Without training texts all bytes are equally
likely, and words have the smoothing count alone. A text of any length is one
row; it is read as one piece, a few arrays of its length. An empty table gives
an empty one. Only the id and text columns are read, under names of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_mod, deflate, inflate, map_batches, materialise, table, text_bytes, text_bytes_total

ORDER = 5
#: Marks that UTF-8 never has.
START, STOP = 0xFE, 0xFF
#: Symbols that may follow: all bytes but the start mark.
SYMBOLS = 255
RUNS, HOT, LEAST_HOT = 1 << 20, 1 << 17, 64
#: Distinct runs that one part of the model is meant to hold.
PART = 1_000_000
#: No run has this number; an odd multiplier that mixes numbers.
FREE, MIX = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)
RUN_COUNT = pa.schema([("run", pa.uint64()), ("n", pa.int64())])
#: Bytes of text handled at once, words held by a task before it sends them, bytes of text for each shard.
PIECE, HELD, SHARD = 1_500_000, 300_000, 64_000_000
SMOOTH = 0.1
#: What each byte seen after a context gives to its escape.
DISCOUNT = 0.5


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All runs of ORDER + 1 bytes that end in a text's byte or end mark, as numbers, and where each text's begin."""
    pad = bytes([START]) * ORDER
    flat = np.frombuffer(b"".join([x for t in texts for x in (pad, t, b"\xff")]) or b"", np.uint8)
    n = len(flat) - ORDER
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs = np.zeros(n, np.uint64)
    for j in range(ORDER + 1):
        runs = (runs << np.uint64(8)) | flat[j : j + n].astype(np.uint64)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return runs[flat[ORDER:] != START], starts


def pieces(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in groups of some size, with the number of each group's first."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) < most):
            held += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def count_runs(docs: DataFrame) -> DataFrame:
    """(run, n, every) over all texts t: how often a run is in training texts, and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            runs, n, every = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(runs, kind="stable")
            runs, n, every = runs[order], n[order], every[order]
            first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
            return runs[first], np.add.reduceat(n, first), np.add.reduceat(every, first)

        def rows(runs: np.ndarray, n: np.ndarray, every: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(runs), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(runs[part].view(np.int64)), pa.array(n[part]), pa.array(every[part])], ["run", "n", "every"])

        for b in batches:
            texts, out = [(t or b"").lower() for t in text_bytes(b, "t")], b.column("held_out").to_pylist()
            for held_out in (False, True):
                for _, part in pieces([t for t, o in zip(texts, out, strict=True) if o == held_out], 4_000_000):
                    runs, every = np.unique(runs_of(part)[0], return_counts=True)
                    held.append((runs, every * (not held_out), every))
                    if sum(len(x[0]) for x in held) > 3_000_000:
                        held[:] = [merged()]
                        if len(held[0][0]) > 2_000_000:
                            yield from rows(*held.pop())
        if held:
            yield from rows(*merged())

    counted = map_batches(docs.select("t", "held_out"), count, "run long, n long, every long")
    return counted.groupBy("run").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def levels_of(runs: np.ndarray, n: np.ndarray, orders: range) -> tuple[list, list]:
    """Sorted runs of j + 1 bytes and counts, and sorted contexts of j bytes and how often they occur, for each j, from longer runs and counts."""

    def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(keys, return_inverse=True)
        return keys, np.bincount(back, n, len(keys)).astype(np.int64)

    levels, contexts = [], []
    for j in orders:
        levels.append(summed(runs & np.uint64((1 << 8 * (j + 1)) - 1), n))
        contexts.append(summed(levels[-1][0] >> np.uint64(8), levels[-1][1]))
    return levels, contexts


class Trie:
    """A model, or the part of it that some contexts need. levels[j]: sorted runs of j + 1 bytes and their counts; contexts[j]: sorted contexts of j bytes, and how often they occur."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.runs = [r for r, _ in levels]
        self.counts = [n - DISCOUNT for _, n in levels]
        self.contexts = [c for c, _ in contexts]
        self.kept, self.escape, self.without, self.escape_without = [], [], [], []
        below = []
        for j, (c, total) in enumerate(contexts):
            at = np.searchsorted(c, self.runs[j] >> np.uint64(8))
            kept = np.bincount(at, self.counts[j], len(c))
            held = np.bincount(at, minlength=len(c))
            self.kept.append(kept)
            self.escape.append(total - kept)
            if j:  # what the next shorter context has besides this one's followers
                short = np.searchsorted(self.contexts[j - 1], c & np.uint64((1 << 8 * (j - 1)) - 1))
                same = np.searchsorted(self.runs[j - 1], self.runs[j] & np.uint64((1 << 8 * j) - 1))
                self.without.append(np.maximum(self.kept[j - 1][short] - np.bincount(at, self.counts[j - 1][same], len(c)), 0))
                self.escape_without.append(np.maximum(self.escape[j - 1][short] - DISCOUNT * held, 0))
            below.append(held)
        self.rest = max(1, SYMBOLS - (int(below[0][0]) if len(below[0]) else 0))

    def log10(self, runs: np.ndarray) -> np.ndarray:
        """log10 of each run's last byte after the bytes before it."""
        out, todo = np.zeros(len(runs)), np.arange(len(runs))
        higher = np.full(len(runs), -1, np.int64)  # number of the context that escaped last, one level up
        for j in range(ORDER, -1, -1):
            if not len(self.contexts[j]):
                continue
            run = runs[todo] & np.uint64((1 << 8 * (j + 1)) - 1)
            context = run >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[j], context), len(self.contexts[j]) - 1)
            known = self.contexts[j][at] == context
            up = higher[todo]
            kept, escape = self.kept[j][at], self.escape[j][at]
            if j < ORDER and len(self.contexts[j + 1]):
                kept, escape = np.where(up >= 0, self.without[j][up], kept), np.where(up >= 0, self.escape_without[j][up], escape)
            where = np.minimum(np.searchsorted(self.runs[j], run), len(self.runs[j]) - 1)
            seen = known & (self.runs[j][where] == run)
            whole = kept + escape
            out[todo[seen]] += np.log10(self.counts[j][where[seen]] / whole[seen])
            paid = known & ~seen & (whole > 0) & (escape > 0)
            out[todo[paid]] += np.log10(escape[paid] / whole[paid])
            higher[todo[known]] = at[known]
            todo = todo[~seen]
            if not len(todo):
                return out
        out[todo] -= log10(self.rest if len(self.contexts[0]) else SYMBOLS)
        return out


class Costs:
    """An open-addressed table of runs and their costs."""

    def __init__(self, runs: np.ndarray, costs: np.ndarray) -> None:
        bits = max(4, int(2 * len(runs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, FREE, np.uint64)
        self.costs = np.full(1 << bits, np.nan)
        at, left = self.slot(runs), np.arange(len(runs))
        while len(left):
            free = self.keys[at] == FREE
            self.keys[at[free]] = runs[left[free]]
            won = self.keys[at] == runs[left]
            self.costs[at[won]] = costs[left[won]]
            at, left = (at[~won] + 1) & (len(self.keys) - 1), left[~won]

    def slot(self, runs: np.ndarray) -> np.ndarray:
        return ((runs * MIX) >> self.shift).astype(np.int64)

    def of(self, runs: np.ndarray) -> np.ndarray:
        """The cost of each run; NaN of one that the table lacks."""
        at = self.slot(runs)
        out = self.costs[at]
        todo = np.flatnonzero(self.keys[at] != runs)
        at = at[todo]
        while len(todo):
            lost = self.keys[at] == FREE
            out[todo[lost]] = np.nan
            todo, at = todo[~lost], (at[~lost] + 1) & (len(self.keys) - 1)
            hit = self.keys[at] == runs[todo]
            out[todo[hit]] = self.costs[at[hit]]
            todo, at = todo[~hit], at[~hit]
        return out


def run_costs(counted: DataFrame, part_runs: int = PART) -> DataFrame:
    """(run, every, cost) of each run that any text has, by the whole model.

    A part holds all contexts that end in the same two bytes, so it has
    whatever its runs back off to, but for contexts of one byte and none: those
    are at most 256 * 257 runs, which all parts get. The contexts of two bytes
    that have more runs than a part is meant to hold are parted by a third byte;
    each of their parts gets the followers of the two bytes, at most 256 of each.
    """
    spark = counted.sparkSession
    parts = 12 + counted.count() // part_runs
    pair = F.shiftrightunsigned("run", 8).bitwiseAND(F.lit(0xFFFF))
    hot = sorted(r["pair"] for r in counted.groupBy(pair.alias("pair")).count().where(F.col("count") > part_runs).collect())  # of 65536 pairs

    def sums(rows: DataFrame, mask: int, orders: range) -> tuple[list, list]:
        got = rows.where("n > 0").groupBy(F.col("run").bitwiseAND(F.lit(mask)).alias("run")).agg(F.sum("n").alias("n")).toArrow()
        return levels_of(*(c.to_numpy() for c in got.cast(RUN_COUNT).columns), orders)

    short = spark.sparkContext.broadcast(sums(counted, 0xFFFF, range(2)))
    hot_pairs = spark.sparkContext.broadcast((np.array(hot, np.uint64), sums(counted.where(pair.isin(hot)), 0xFFFFFF, range(2, 3)) if hot else None))

    def cost(rows: pa.Table) -> pa.Table:
        runs, n = rows.column("run").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        split, followers = hot_pairs.value
        learned, n = runs[n > 0], n[n > 0]
        own = (learned >> np.uint64(8)) & np.uint64(0xFFFF)
        whole = ~np.isin(own, split)
        second = levels_of(learned[whole], n[whole], range(2, 3))
        if not whole.all():
            present = np.unique(own[~whole])
            kept = [[(k[m], c[m]) for k, c in level for m in [np.isin(k >> np.uint64(shift), present)]] for level, shift in zip(followers, (8, 0), strict=True)]
            second = tuple([tuple(x[order] for x in both)] for mine, more in zip(second, kept, strict=True) for both in [[np.concatenate(x) for x in zip(mine[0], more[0], strict=True)]] for order in [np.argsort(both[0])])
        longer = levels_of(learned, n, range(3, ORDER + 1))
        trie = Trie(*(a + b + c for a, b, c in zip(short.value, second, longer, strict=True)))
        return pa.table({"run": rows.column("run"), "every": rows.column("every"), "cost": trie.log10(runs)})

    triple = F.shiftrightunsigned("run", 8).bitwiseAND(F.lit(0xFFFFFF))
    place = F.when(pair.isin(hot), F.xxhash64(triple)).otherwise(F.xxhash64(pair)) if hot else F.xxhash64(pair)
    return counted.withColumn("part", F.pmod(place, F.lit(parts))).groupBy("part").applyInArrow(cost, "run long, every long, cost double")


def frequent(costs: DataFrame, runs: int) -> int:
    """The least number of occurrences that at most so many runs have."""
    steps = costs.groupBy(F.floor(F.log2("every") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("every").alias("least")).collect()  # a few hundred rows
    least, held = 1 << 62, 0
    for s in sorted(steps, key=lambda s: -s["step"]):
        if held + s["n"] > runs:
            break
        held, least = held + s["n"], s["least"]
    return least


_costs: dict[str, Costs] = {}


def costs_of(name: str, shared) -> Costs:
    """The broadcast costs of that name, made ready once in each worker."""
    if name not in _costs:
        _costs.clear()
        _costs[name] = Costs(*shared.value)
    return _costs[name]


def run_shards(runs: np.ndarray, shards: int) -> np.ndarray:
    return (((runs * MIX) >> np.uint64(24)) % np.uint64(shards)).astype(np.int32)


def cost_messages(cold: DataFrame, shards: int) -> DataFrame:
    """The costs of runs, packed by the shard that is asked for them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, costs = b.column("run").to_numpy().view(np.uint64), b.column("cost").to_numpy()
            order = np.argsort(runs)
            runs, costs = runs[order], costs[order]
            shard = run_shards(runs, shards)
            for s in np.unique(shard):
                own = shard == s
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([deflate(x)], pa.binary()) for x in (np.diff(runs[own], prepend=np.uint64(0)), costs[own]))], ["shard", "runs", "costs"])

    return map_batches(cold.select("run", "cost"), pack, "shard int, runs binary, costs binary")


def shard_of(word: bytes, shards: int) -> int:
    """A hash that all workers agree on."""
    return (int.from_bytes(word[-8:], "little") * 0x9E3779B97F4A7C15 + len(word) * 0xC2B2AE3D27D4EB4F >> 17) % shards


def packed_words(words: list[bytes]) -> bytes:
    return deflate(np.frombuffer(b" ".join(words), np.uint8))


def word_counts(docs: DataFrame, shards: int, hot: int) -> tuple[int, int, dict[bytes, int]]:
    """Training words, distinct training words, and the training counts of words that occur hot or more times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, learned = Counter(), Counter()

        def send() -> Iterator[pa.RecordBatch]:
            by: list[list[bytes]] = [[] for _ in range(shards)]
            for w in every:
                by[shard_of(w, shards)].append(w)
            for s, words in enumerate(by):
                if words:
                    a, n = (np.array([c[w] for w in words], np.uint32) for c in (every, learned))
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in (packed_words(words), deflate(a), deflate(n)))], ["shard", "words", "every", "learned"])
            every.clear()
            learned.clear()

        for b in batches:
            for t, out in zip(text_bytes(b, "t"), b.column("held_out").to_pylist(), strict=True):
                words = (t or b"").lower().split()
                every.update(words)
                if not out:
                    learned.update(words)
                if len(every) > HELD:
                    yield from send()
        yield from send()

    def add(messages: pa.Table) -> pa.Table:
        every, learned = Counter(), Counter()
        for words, a, n in zip(*(messages.column(c).to_pylist() for c in ("words", "every", "learned")), strict=True):
            words = bytes(inflate(words, np.uint8)).split(b" ")
            for w, x, y in zip(words, inflate(a, np.uint32).tolist(), inflate(n, np.uint32).tolist(), strict=True):
                every[w] += x
                if y:
                    learned[w] += y
        found = [w for w, n in every.items() if n >= hot]
        return pa.table({"words": [sum(learned.values())], "distinct": [len(learned)], "hot": pa.array([found], pa.list_(pa.binary())), "n": pa.array([[learned[w] for w in found]], pa.list_(pa.int64()))})

    got = map_batches(docs.select("t", "held_out"), count, "shard int, words binary, every binary, learned binary").groupBy("shard").applyInArrow(add, "words long, distinct long, hot array<binary>, n array<long>")
    rows = got.collect()  # a row for each shard; at most all words / hot of them are hot
    return sum(r["words"] for r in rows), sum(r["distinct"] for r in rows), {bytes(w): n for r in rows for w, n in zip(r["hot"], r["n"], strict=True)}


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, runs: int = RUNS, hot: int = HOT, part_runs: int = PART) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learned from rows outside fold 0, log10 probabilities of all."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    docs = docs.withColumn("held_out", crc_mod(F.col("id"), folds) == 0)
    spark, size = docs.sparkSession, text_bytes_total(docs, "t")
    costs = materialise(run_costs(materialise(count_runs(docs)), part_runs))
    often = frequent(costs, runs)
    top = costs.where(F.col("every") >= often).select("run", "cost").toArrow()  # at most `runs` rows
    model, name = spark.sparkContext.broadcast((top.column("run").to_numpy().view(np.uint64), top.column("cost").to_numpy())), uuid4().hex
    shards, least = 12 + size // SHARD, max(LEAST_HOT, size // 2 // hot + 1)
    words, distinct, common = word_counts(docs, shards, least)
    ends = docs.where("not held_out").count()
    total, vocabulary = words + ends, distinct + bool(ends)
    hot_words = spark.sparkContext.broadcast(common)  # at most `hot` words: each occurs `least` times at least

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_costs = costs_of(name, model)
        gain = {w: (log10(n + SMOOTH), n > 0) for w, n in hot_words.value.items()}
        task, message = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {}
        seen, of, doc, times, about, rare = Counter(), [], [], [], [], []

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal message
            own = list(number)
            shard = np.array([shard_of(w, shards) for w in own], np.int64)
            w, d, n = np.array(of, np.int64), np.array(doc, np.uint32), np.array(times, np.uint32)
            run, run_doc = (np.concatenate([np.zeros(0, k), *(r[i] for r in rare)]) for i, k in ((0, np.uint64), (1, np.uint32)))
            run, run_of = np.unique(run, return_inverse=True)
            run_shard = run_shards(run, shards)
            place = np.zeros(len(own), np.int64)
            run_place = np.zeros(len(run), np.int64)
            for s in range(shards):
                mine = np.flatnonzero(shard == s)
                place[mine] = np.arange(len(mine))
                chosen = np.flatnonzero(shard[w] == s) if len(w) else w
                info = [pa.array([about if s == message % shards else []], ABOUT)]
                asked = np.flatnonzero(run_shard == s)
                run_place[asked] = np.arange(len(asked))
                at = np.flatnonzero(run_shard[run_of] == s) if len(run) else asked
                if len(mine) or len(asked) or s == message % shards:
                    names = [own[i] for i in mine]
                    packed = (packed_words(names), deflate(np.array([seen[x] for x in names], np.uint32)), deflate(place[w[chosen]].astype(np.uint32)), deflate(d[chosen]), deflate(n[chosen]), deflate(np.diff(run[asked], prepend=np.uint64(0))), deflate(run_place[run_of[at]].astype(np.uint32)), deflate(run_doc[at]))
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([task << 24 | message]), *(pa.array([x], pa.binary()) for x in packed), *info], ["shard", "message", *PACKED, "about"])
            message += 1
            for x in (number, seen, of, doc, times, about, rare):
                x.clear()

        for b in batches:
            ids, out = b.column("id").to_pylist(), b.column("held_out").to_pylist()
            for at, texts in pieces([(t or b"").lower() for t in text_bytes(b, "t")]):
                runs, starts = runs_of(texts)
                cost = known_costs.of(runs)
                cold = np.flatnonzero(np.isnan(cost))
                cost[cold] = 0
                scores = np.add.reduceat(cost, starts)
                rare.append((runs[cold], (len(about) + np.searchsorted(starts, cold, "right") - 1).astype(np.uint32)))
                for i, t in enumerate(texts):
                    words = t.split()
                    gained, known = 0.0, 0
                    for w, n in Counter(words).items():
                        if g := gain.get(w):
                            gained += n * g[0]
                            known += n * g[1]
                        else:
                            of.append(number.setdefault(w, len(number)))
                            doc.append(len(about))
                            times.append(n)
                            if not out[at + i]:
                                seen[w] += n
                    about.append({"doc": len(about), "id": ids[at + i], "held_out": out[at + i], "tokens": len(words) + 1, "known": known, "gain": gained, "score": float(scores[i])})
                if len(number) > HELD or len(about) > 50_000 or len(of) > 4_000_000 or sum(len(r[0]) for r in rare) > 2_000_000:
                    yield from send()
        yield from send()

    PACKED = ["words", "seen", "of", "doc", "times", "runs", "run_of", "run_doc"]
    ABOUT = pa.list_(pa.struct([("doc", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.int64()), ("known", pa.int64()), ("gain", pa.float64()), ("score", pa.float64())]))

    def answer(messages: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        own_costs = messages.filter(pa.compute.is_valid(messages.column("costs")))
        messages = messages.filter(pa.compute.is_null(messages.column("costs")))
        known_runs, run_cost = (np.concatenate([np.zeros(0, k), *x]) for k, x in ((np.uint64, [np.cumsum(inflate(x, np.uint64)) for x in own_costs.column("runs").to_pylist()]), (np.float64, [inflate(x, np.float64) for x in own_costs.column("costs").to_pylist()])))
        order = np.argsort(known_runs)
        known_runs, run_cost = known_runs[order], run_cost[order]
        rows = list(zip(*(messages.column(c).to_pylist() for c in ("message", *PACKED)), strict=True))
        places, counts = [], []
        for _, words, seen, *_ in rows:
            words = bytes(inflate(words, np.uint8)).split(b" ") if len(inflate(seen, np.uint32)) else []
            places.append(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
            counts.append(inflate(seen, np.uint32))
        n = np.zeros(len(number))
        for p, c in zip(places, counts, strict=True):
            n[p] += c
        gain, out, scored = np.log10(n + SMOOTH), [[], [], [], []], [[], [], []]
        for (message, _, _, of, doc, times, runs, run_of, run_doc), p in zip(rows, places, strict=True):
            run_doc = inflate(run_doc, np.uint32)
            if len(run_doc):
                own, back = np.unique(run_doc, return_inverse=True)
                cost = run_cost[np.searchsorted(known_runs, np.cumsum(inflate(runs, np.uint64)))]
                for o, x in zip(scored, (np.full(len(own), message), own.astype(np.int64), np.bincount(back, cost[inflate(run_of, np.uint32)])), strict=True):
                    o.append(x)
            doc, times = inflate(doc, np.uint32), inflate(times, np.uint32).astype(np.float64)
            if len(doc):
                w = p[inflate(of, np.uint32)]
                own, back = np.unique(doc, return_inverse=True)
                for o, x in zip(out, (np.full(len(own), message), own.astype(np.int64), np.bincount(back, times * gain[w]), np.bincount(back, times * (n[w] > 0)).astype(np.int64)), strict=True):
                    o.append(x)
        told = messages.column("about").combine_chunks()
        told = told.flatten() if isinstance(told, pa.ListArray) else pa.concat_arrays([c.flatten() for c in told.chunks])
        sizes = [len(x) for x in messages.column("about").to_pylist()]
        of_message = np.repeat(np.array([r[0] for r in rows], np.int64), sizes)
        part = {c: (np.concatenate(o) if o else np.zeros(0, k)) for c, o, k in zip(("message", "doc", "gain", "known"), out, (np.int64, np.int64, np.float64, np.int64), strict=True)}
        first = pa.table({"message": of_message, **{f: told.field(f) for f in ("doc", "id", "held_out", "tokens", "known", "gain", "score")}})
        rest = pa.table({"message": part["message"], "doc": part["doc"], **{f: pa.nulls(len(part["doc"]), t) for f, t in (("id", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.int64()))}, "known": part["known"], "gain": part["gain"], "score": pa.nulls(len(part["doc"]), pa.float64())})
        message, doc, score = (np.concatenate([np.zeros(0, k), *o]) for o, k in zip(scored, (np.int64, np.int64, np.float64), strict=True))
        rare = pa.table({c: {"message": message, "doc": doc, "score": score}.get(c, pa.nulls(len(doc), t)) for c, t in zip(first.column_names, first.schema.types, strict=True)})
        return pa.concat_tables([first, rest, rare])

    asked = map_batches(docs, ask, "shard int, message long, words binary, seen binary, of binary, doc binary, times binary, runs binary, run_of binary, run_doc binary, about array<struct<doc:long,id:long,held_out:boolean,tokens:long,known:long,gain:double,score:double>>")
    asked = asked.unionByName(cost_messages(costs.where(F.col("every") < often), shards), allowMissingColumns=True)
    parts = asked.groupBy("shard").applyInArrow(answer, "message long, doc long, id long, held_out boolean, tokens long, known long, gain double, score double")
    got = parts.groupBy("message", "doc").agg(F.max("id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("tokens").alias("n_tokens"), F.sum("known").alias("known"), F.sum("gain").alias("gain"), F.sum("score").alias("score"))
    base = F.col("gain") + log10(ends + SMOOTH) - F.col("n_tokens") * log10(total + SMOOTH * (vocabulary + 1))
    return got.select("doc_id", "held_out", "n_tokens", (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
