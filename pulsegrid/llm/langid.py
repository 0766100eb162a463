"""Language identification as inference of a mixture.

Each language has smoothed counts of hashed byte 4-grams, learned from all
labelled training texts. A document is a mixture of languages, word by word:
expectation-maximisation estimates the proportions from the words' n-gram
likelihoods, then the set of languages is the nested one (most present first)
whose log-likelihood, less ``penalty`` times the logarithm of the words for
each language, is highest. All nested sets count, from one language to all;
larger ones are left out only where a bound on the likelihood of any mixture
shows that none of them can be better. The prediction is the largest part of
that set, and its score that part.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as
is every text when there is nothing to learn from; labels that are null are not
learned from; ties go to the language that sorts first. Repeated rows stay. A
very long text is looked up in pieces; its words by languages are one matrix.
An empty table gives an empty one. Columns are read under names of their own,
so those named in carry may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_mod, map_batches, table

CELLS_BITS, GRAM, SMOOTH = 16, 4, 0.5
#: Overlapping n-grams repeat each other, so a word's log-likelihood counts by this share.
TEMPER = 0.5
ROUNDS, PENALTY = 8, 3.0
PIECE = 400_000
_LETTER = regex.compile(r"\p{L}")


def cells_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-gram that starts at each byte of the texts, where the words begin, and where each text's words begin (a text has one word at least)."""
    parts = [b" ".join(t.lower().encode().split()) + b" " for t in texts]
    flat = np.frombuffer(b"".join(parts) + b" " * GRAM, np.uint8)
    n = len(flat) - GRAM
    code = np.zeros(n, np.uint32)
    for j in range(GRAM):
        code = (code << np.uint32(8)) | flat[j : j + n]
    cells = (code * np.uint32(2654435761)) >> np.uint32(32 - CELLS_BITS)
    space = flat[:n] == 32
    begin = np.flatnonzero(np.concatenate([[True], space[:-1]]))
    ends = np.cumsum([len(p) for p in parts])
    return cells, begin, np.searchsorted(begin, np.concatenate([[0], ends[:-1]]))


def pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held < PIECE):
            held += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities (cells x languages), from columns t and lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                cell = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(counts[cell])], ["lang", "cell", "n"])
            held.clear()

        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            texts = b.column("t").to_pylist()
            for lang in dict.fromkeys(langs):
                for _, part in pieces([t for t, x in zip(texts, langs, strict=True) if x == lang and t]):
                    counts = np.bincount(cells_of(part)[0], minlength=1 << CELLS_BITS)
                    held[lang] = held[lang] + counts if lang in held else counts
                if len(held) > 200:
                    yield from rows()
        yield from rows()

    counted = map_batches(docs.select("t", "lang"), count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()  # cells x languages at most
    langs = sorted(set(counted["lang"]))
    n = np.zeros((1 << CELLS_BITS, len(langs)))
    n[counted["cell"].to_numpy(np.int64), counted["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = counted["n"]
    return langs, np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * len(n))).astype(np.float32)


def word_likelihoods(cells: np.ndarray, words: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log-likelihoods (words x languages): sums over the n-grams that start in each word, a piece of words at a time."""
    out, at = np.empty((len(words), logs.shape[1])), 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(words, words[at] + PIECE)))
        end = words[to] if to < len(words) else len(cells)
        out[at:to] = np.add.reduceat(logs[cells[words[at] : end]], words[at:to] - words[at])
        at = to
    return out


def mixtures(word: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions (texts x languages) of the best set, from words' log-likelihoods (words x languages)."""
    sizes = np.diff(np.append(starts, len(word)))
    like = np.exp(word - word.max(axis=1, keepdims=True))
    text = np.repeat(np.arange(len(starts)), sizes)

    def fit(like: np.ndarray, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions, their log-likelihood, and a bound on that of any mixture."""
        for _ in range(ROUNDS):
            own = like * share[text]
            share = np.add.reduceat(own / np.maximum(own.sum(axis=1, keepdims=True), 1e-300), starts) / sizes[:, None]
        mixed = np.maximum((like * share[text]).sum(axis=1), 1e-300)
        fitted = np.add.reduceat(np.log(mixed), starts)
        # By concavity no mixture gains more than the steepest mean ratio of a language to this mixture.
        steepest = (np.add.reduceat(like / mixed[:, None], starts) / sizes[:, None]).max(axis=1)
        return share, fitted, fitted + sizes * np.log(np.maximum(steepest, 1))

    langs = word.shape[1]
    share, _, most = fit(like, text, starts, sizes, np.full((len(starts), langs), 1 / langs))
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    best, price = (rank == 0).astype(float), penalty * np.log(sizes + 1)
    first = rank.argmin(axis=1)
    value = np.add.reduceat(np.log(np.maximum(like[np.arange(len(like)), first[text]], 1e-300)), starts) - price
    open_ = np.arange(len(starts))
    for k in range(2, langs + 1):
        open_ = open_[most[open_] - k * price[open_] > value[open_]]
        if not len(open_):
            break
        of = np.isin(text, open_)
        own_sizes = sizes[open_]
        own_starts = np.cumsum(own_sizes) - own_sizes
        part = share[open_] * (rank[open_] < k)
        part, fitted, _ = fit(like[of], np.repeat(np.arange(len(open_)), own_sizes), own_starts, own_sizes, part / np.maximum(part.sum(axis=1, keepdims=True), 1e-300))
        fitted = fitted - k * price[open_]
        better = fitted > value[open_]
        value[open_[better]] = fitted[better]
        best[open_[better]] = part[better]
    return best


def identify(docs: DataFrame, langs: list[str], logs: np.ndarray, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, languages, proportions) and the columns named in carry: languages present, most first."""
    model = docs.sparkSession.sparkContext.broadcast(logs)  # cells x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        for b in batches:
            texts = [t or "" for t in b.column("t").to_pylist()]
            rows = []
            for _, part in pieces(texts):
                if langs:
                    cells, words, starts = cells_of(part)
                    share = mixtures(word_likelihoods(cells, words, logs) * TEMPER, starts, penalty)
                for i, t in enumerate(part):
                    if not langs or not _LETTER.search(t):
                        rows.append(("und", 0.0, [], []))
                        continue
                    order = [j for j in np.argsort(-share[i], kind="stable") if share[i, j] > 0]
                    rows.append((langs[order[0]], min(1.0, float(share[i, order[0]])), [langs[j] for j in order], [float(share[i, j]) for j in order]))
            a, s, l, p = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(a, pa.string()), pa.array(s, pa.float64()), pa.array(l, pa.list_(pa.string())), pa.array(p, pa.list_(pa.float64())), *(b.column(f"c{j}") for j in range(len(carry)))], ["doc_id", "lang_pred", "score", "languages", "proportions", *(f"c{j}" for j in range(len(carry)))])

    taken = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), *(F.col(c).alias(f"c{j}") for j, c in enumerate(carry)))
    schema = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>" + "".join(f", c{j} {taken.schema[f'c{j}'].dataType.simpleString()}" for j in range(len(carry)))
    return map_batches(taken, run, schema).withColumnsRenamed({f"c{j}": c for j, c in enumerate(carry)})


def train_fold(docs: DataFrame, folds: int = 4, out: int = 2) -> tuple[list[str], np.ndarray]:
    """Learns from labelled rows outside the held-out fold."""
    return train(docs.where((crc_mod(F.col("doc_id"), folds) != out) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").alias("t"), "lang"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = identify(docs.select("doc_id", "text"), *train_fold(docs.select("doc_id", "text", "lang")))
    return got.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "languages", "proportions")
