"""Byte-pair encoding by backtracking, and decoding by an offset table.

The merges of a word are the one way to cut it into tokens in which every two
neighbours are compatible: merging their join gives just these two. So the
encoder reads left to right, takes the longest token that an Aho-Corasick
automaton found at each place, goes to the next shorter one where the pair with
the token before isn't compatible, and steps back where nothing fits. Places
shown to be dead ends are marked, so the time is linear in the word. Words
recur, so a bounded memo keeps what common ones gave.

Decoding lays all tokens' texts in one byte string; a token is a slice of it
between two offsets, and whole documents are gathered at once.

Cutting a text into words follows the tokenizer file's normaliser and pattern:
for texts within Latin-1 by an equal pattern here, for others by the
tokenizers library's own normaliser and pre-tokeniser. The library never
encodes here; tests compare with it.

Defined cases: a null text is empty: no tokens, empty decoded text. Special
tokens that occur in a text are encoded as such. Repeated rows stay. A text of
any length is encoded whole, word by word, so memory follows the text and its
tokens. An empty table gives an empty one. Only the id and text columns are
read, under names of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import map_batches, table

#: Words whose tokens a worker remembers, and the longest that it does.
MEMO, MEMO_CHARS = 250_000, 48
#: Stands for the end of a word inside a token's text; no byte symbol.
END = "\x00"
#: Before a word that is in byte symbols already; not in Latin-1.
MARK = "\uffff"

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else 256 and on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder for a tokenizer file of BPE with word ends over byte symbols."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_str(definition)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]
        self.latin = split == {"Regex": _PATTERN} and [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        inner = lambda s: s[: -len(end)] + END if end and s.endswith(end) else s
        ids = {inner(s): i for s, i in model["vocab"].items()}
        self.ids, self.special = ids, {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.symbols = {i: s for i, s in enumerate(byte_symbols())}
        special = set(self.special.values())
        most = max(ids.values()) + 1
        self.length, self.shorter, self.single = [0] * most, [-1] * most, {}
        self.auto = ahocorasick.Automaton()
        for s, i in ids.items():
            if i in special:
                continue
            self.length[i] = len(s)
            # A token's next shorter prefix that is a token as well.
            self.shorter[i] = next((ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in ids), -1)
            if len(s) == 1:
                self.single[s] = i
            else:
                self.auto.add_word(s, i << 16 | len(s) - 1)
        self.auto.make_automaton()
        # Merges: the rank at which a pair joins, and the pair and rank that made a token.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = inner(a), inner(b)
            if a + b in ids:
                self.rank.setdefault((ids[a], ids[b]), r)
                self.made.setdefault(ids[a + b], (ids[a], ids[b], r))
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}
        text = {**{i: s for s, i in model["vocab"].items()}, **{i: s for s, i in self.special.items()}}
        parts = [(text.get(i, "") + " ").encode() for i in range(max(text) + 1)]
        self.table = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def compatible(self, a: int, b: int) -> bool:
        """Do the merges of a's and b's joined text keep them apart?

        Undoes the later made of the two tokens that face each other at the
        border, again and again; they would have joined if, while both were
        whole, their merge came before the one that hid either of them.
        """
        left, right, hidden, apart = a, b, (1 << 60, 0), True
        while True:
            r = self.rank.get((left, right))
            # On the left a merge of equal rank to its right neighbour comes first; on the right it comes later.
            if r is not None and (r, 1) < hidden:
                apart = False
                break
            lm, rm = self.made.get(left), self.made.get(right)
            if lm is None and rm is None:
                break
            if rm is None or lm is not None and lm[2] > rm[2]:
                hidden, left = (lm[2], 0), lm[1]
            elif lm is None or rm[2] > lm[2]:
                hidden, right = (rm[2], 2), rm[0]
            else:  # the same token twice: the left one is made first, so the right one is undone first
                hidden, right = (rm[2], 2), rm[0]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[a << 32 | b] = apart
        return apart

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Tokens of one word in byte symbols, its end mark included."""
        if (whole := self.ids.get(word)) is not None:
            return (whole,)
        n, length, shorter, pairs = len(word), self.length, self.shorter, self.pairs
        single = self.single
        longest = [single.get(c, -1) for c in word]
        for last, found in self.auto.iter(word):
            longest[last - (found & 0xFFFF)] = found >> 16  # ends grow, so the longest is set last
        alive, out, at, token, before = bytearray(b"\1") * (n + 1), [], 0, longest[0], -1
        while True:
            while token < 0:
                alive[at] = 0
                last = out.pop()
                before = out[-1] if out else -1
                at -= length[last]
                token = shorter[last]
            to = at + length[token]
            if alive[to] and (before < 0 or (self.compatible(before, token) if (fit := pairs.get(before << 32 | token)) is None else fit)):
                out.append(token)
                if to == n:
                    return tuple(out)
                at, before, token = to, token, longest[to]
            else:
                token = shorter[token]

    def word(self, word: str) -> tuple[tuple[int, ...], str]:
        """Tokens of a word in byte symbols, and their ids joined by spaces."""
        got = self.encode_word(word + END)
        return got, " ".join(map(str, got))

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens, those of Latin-1 texts as they are, others in byte symbols with a mark before."""
        if self.latin:
            try:
                text.encode("latin-1")
                return _LATIN.findall(text.lower())
            except UnicodeEncodeError:
                pass
        normal = self.library.normalizer.normalize_str(text)
        return [MARK + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def look_up(self, word: str) -> tuple[tuple[int, ...], str]:
        """What word() gives, remembered: two generations, of which the older goes when the newer is full."""
        got = self.older.get(word) or self.word(word[1:] if word[0] == MARK else word.encode().decode("latin-1").translate(self.symbols))
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[word] = got
        return got

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids, and their decimal forms joined by spaces."""
        if self.cut is not None and self.cut.search(text):
            pieces = self.cut.split(text)
        else:
            pieces = [text]
        got = []
        for p in pieces:
            if p in self.special:
                got.append(((self.special[p],), str(self.special[p])))
            elif p:
                look = self.look_up
                got.extend([self.memo.get(w) or look(w) for w in self.words(p)])
        ids = np.fromiter(chain.from_iterable([g[0] for g in got]), np.int32)
        return ids, " ".join([g[1] for g in got])

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts joined by spaces, in UTF-8."""
        if not len(ids):
            return b""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return self.table[shift + np.arange(len(shift))].tobytes()[:-1]


@lru_cache(maxsize=2)
def loaded(definition: str) -> Bpe:
    return Bpe(definition)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256); without the ids themselves if ids is false.

    tokenizer is the path of a tokenizers file, read on the driver. decoded_sha256
    is of the text that decoding the ids gives back.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size
    fields = ["doc_id long"] + ["ids array<int>"] * ids + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = loaded(definition.value), hashlib.sha256
        for b in batches:
            rows = []
            for t in b.column("t").to_pylist():
                got, joined = bpe.encode(t or "")
                rows.append((got if ids else None, len(got), sha(joined.encode()).hexdigest(), sha(bpe.decode(got)).hexdigest()))
            own, n, a, d = zip(*rows, strict=True) if rows else ((),) * 4
            columns = [b.column("id")] + [pa.array(own, pa.list_(pa.int32()))] * ids + [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in fields])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), run, ", ".join(fields))


def decode_documents(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids give null."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(definition.value)
        for b in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")), run, "doc_id long, text string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer(), ids=False)
