"""Each operator against brute force on a small fixture with nulls, empty texts, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import random
import textwrap
import time
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm import bpe, embedding, fingerprint, langid, license, license_templates, lm, mixing, queries, sharding, simhash, substring
from pulsegrid.llm._common import connected_components, materialise, tables_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    rng = random.Random(3)
    words = {"en": [f"{a}{b}" for a in ("th", "an", "ing", "er") for b in ("e", "ou", "at", "is", "on")], "fr": [f"{a}{b}" for a in ("é", "le", "qu", "au") for b in ("è", "ion", "eux", "ment")]}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.choice([1, 4, 20, 60, 200]))), lang, f"s{i % 4}"))
    rows[7] = (7, rows[4][1] + " tail", "en", "s1")
    rows[8] = (8, rows[4][1], "en", "s0")
    rows += [(100, None, "en", "s1"), (101, "", None, None), (102, " \t\n", "en", "s1"), (103, "12 34 !!", None, "s2"), (104, "word " * 5000, "en", "s0"), (105, rows[5][1], "en", None), (105, rows[5][1], "en", None), (None, rows[6][1], "fr", "s2"), (106, "É\xa0x Ω <|endoftext|> İ", "fr", "s3")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return sorted((((r["doc_id"] is None, r["doc_id"] or 0), *(r[c] for c in columns)) for r in df.collect()), key=str)


def want(f):
    return sorted((((r[0] is None, r[0] or 0), *f(r)) for r in corpus()), key=str)


def by_rows(rows):
    return sorted(rows, key=str)


def split(t):
    return (t or "").encode().split()


def test_simhash(docs, none):
    def fp(t):
        w = split((t or "").encode().lower().decode())
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rows = corpus()
    fps = [fp(r[1]) for r in rows]
    low = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            low[i] = min(low[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2)
    groups = {k: min((rows[i][0] for i in range(len(rows)) if low[i] == k and rows[i][0] is not None), default=None) for k in low}
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(docs).collect())
    assert got == sorted(((r[0] is None, r[0] or 0), f, groups[k]) for r, f, k in zip(rows, fps, low, strict=True))
    assert simhash.simhash_components(none).count() == 0
    near = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(docs).collect()}
    assert near[4] == near[8] == 4 and 104 not in near and 100 not in near


def near_groups(texts: list[str]) -> dict[int, int]:
    """By brute force: ids of 5-word shingle sets of a Jaccard of 0.8 or more, and the smallest id of their group."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    low = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if low[i] != low[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((low[i], low[j]))
                low = [x if r == y else r for r in low]
    return {i: r for i, r in enumerate(low) if low.count(r) > 1}


def assert_groups(spark, texts: list[str], **options) -> dict[int, int]:
    expected = near_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(df, **options).collect()} == expected
    return expected


def test_near_pairs_among_unlike(spark):
    """Pairs of Jaccard 0.85 in a family that shares boilerplate at 0.74 to 0.77: each pair is found, and no two pairs are joined."""
    shared = " ".join(f"b{i}" for i in range(90))
    texts = []
    for i in range(400):
        own, other = [f"w{i}_{k}" for k in range(15)], [f"v{i}_{k}" for k in range(7)]
        texts += [" ".join([shared, *own])] + ([" ".join([shared, *own[:6], *other])] if i % 4 == 0 else [])
    assert len(assert_groups(spark, texts)) == 200


def test_near_short_texts(spark):
    """8 words and the same with a ninth share 4 of 5 shingles: a Jaccard of 0.8."""
    texts = [" ".join(f"s{i}_{k}" for k in range(n)) for i in range(100) for n in (8, 9)]
    assert len(assert_groups(spark, texts)) == 200


def test_near_repeated_lines(spark):
    """Equal sets of shingles are alike, however often a line repeats."""
    texts = []
    for i in range(10):
        head, line = " ".join(f"h{i}_{k}" for k in range(90)), " ".join(f"l{i}_{k}" for k in range(10))
        texts += [f"{head} {line} {line}", f"{head} " + " ".join([line] * 50)]
    assert len(assert_groups(spark, texts)) == 20


def test_near_nothing_unverified(spark):
    """Texts that share one line, repeated, and little else are not alike."""
    texts = [" ".join(["the same line of ten words stands here many times"] * 40 + [f"o{i}_{k}" for k in range(40)]) for i in range(40)]
    assert assert_groups(spark, texts) == {}


def test_near_parts(spark, monkeypatch):
    """Groups don't depend on how postings are dealt out."""
    texts = [" ".join([f"f{i % 4}_{k}" for k in range(60)] + [f"o{i}_{k}" for k in range(i % 12)]) for i in range(60)]
    monkeypatch.setattr(simhash, "PART_ROWS", 3)
    assert assert_groups(spark, texts)


def test_near_parities(spark):
    """Parities never tell two sets further apart than they are, whatever their sizes, and rule out most unlike pairs."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 31, 32, 33, 300, 4000):
        for m in (0, 1, n // 10, n // 2, n):
            x, y = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, n + m // 2))
            y[: max(0, n - m)] = x[: max(0, n - m)]
            differ = len(np.setxor1d(x, np.unique(y)))
            got = simhash.apart(simhash.parity(x), simhash.parity(np.unique(y)))
            assert got <= differ and got % 2 == differ % 2
            assert m < n or n < 300 or got > 2 * n / 9  # unlike


def test_near_parities_at_once(spark):
    """Many parities, folded to a few bytes, are compared as one by one."""
    rng = np.random.default_rng(6)
    few = [simhash.folded(simhash.parity(np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64))), simhash.FEW) for k in (1, 2, 31, 32, 33, 100, 300, 600, 4000, 9000)]
    x, y = (c.ravel() for c in np.meshgrid(range(len(few)), range(len(few))))
    assert simhash.Parities(few).apart(x, y).tolist() == [simhash.apart(few[i], few[j]) for i, j in zip(x, y, strict=True)]


def test_near_copies_that_are_unlike(spark, monkeypatch):
    """Copies of a text, of which no two are alike, make hardly a row of pairs, though all of them meet; those alike, by some other changed word, are found."""
    rng, texts = random.Random(8), []
    for i in range(300):
        text = [f"b{k}" for k in range(150)]
        for k in rng.sample(range(4, 146), 3 + i % 2):
            text[k] = f"c{i}_{k}"
        texts.append(" ".join(text))
        if i % 30 == 0:
            texts.append(" ".join([*text[:-1], "end"]))
    counts, possible = [], simhash.possible
    monkeypatch.setattr(simhash, "possible", lambda pairs, *a: counts.append(pairs.count()) or possible(pairs, *a))
    monkeypatch.setattr(simhash, "PART_ROWS", 60)
    assert len(assert_groups(spark, texts)) >= 20
    assert sum(counts) < 5 * len(texts)  # 20,000 or more, were those that meet all sent


def test_near_leaves_little(spark):
    """The large tables of a search for near-duplicates go with it, and shuffle files with the table that was made of them."""
    files = lambda top: {p for p in Path(top).rglob("*") if p.is_file()}
    top = Path(tables_dir(spark).removeprefix("file://"))
    texts = [" ".join([f"f{i % 4}_{k}" for k in range(60)] + [f"o{i}_{k}" for k in range(i % 12)]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = files(top)
    groups = simhash.near_duplicate_groups(df)
    left = {p.parent for p in files(top) - before if p.suffix == ".parquet"}
    assert groups.count() == 60 and Path(groups.table_path.removeprefix("file://")) in left
    # connected_components keeps what it returns: (node, root) of linked sets.
    assert {tuple(spark.read.parquet(f"file://{d}").columns) for d in left} <= {("doc_id", "group_id"), ("u", "v")}
    local = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {p for d in local for p in files(d) if p.name.startswith("shuffle_") and p.suffix == ".data"}
    before = shuffled()
    made = df.groupBy("text").count().repartition(3, "count")
    kept = materialise(made, clean=True)
    until = time.monotonic() + 20
    while (more := shuffled() - before) and time.monotonic() < until:
        time.sleep(0.1)
    assert not more and kept.count() == made.count() == len(set(texts))


def test_substring(docs, none):
    rows, low = corpus(), {}
    for r in rows:
        w = split(r[1])
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            low[k] = min(low.get(k, float("inf")), float("inf") if r[0] is None else r[0])

    def brute(r):
        w = split(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if low[tuple(w[i : i + 13])] < (float("inf") if r[0] is None else r[0]):
                gone[i : i + 13] = [True] * 13
        return len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()

    assert by_id(substring.dedup_substrings(docs), "n_words", "n_removed", "text") == want(brute)
    for options in ({"bits": 4}, {"chunk": 1000, "group": 50}):  # a sketch that lets nearly all through; many chunks and ranges
        assert by_id(substring.dedup_substrings(docs, **options), "n_words", "n_removed", "text") == want(brute)
    assert substring.dedup_substrings(none).count() == 0
    clash = docs.selectExpr("doc_id", "text", "lang no", "source chunk", "n_chars t", "lang c0")
    assert by_id(substring.dedup_substrings(clash, carry=("t", "no", "chunk", "c0")), "n_words", "no", "chunk", "t") == want(lambda r: (len(split(r[1])), r[2], r[3], r[4]))


def test_lm(spark, docs, none):
    rows = corpus()
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10
    low = lambda t: [w.lower() for w in split(t)]
    learned = [r for r in rows if fold(r[0])]
    c = Counter(w for r in learned for w in low(r[1]))
    c[None] = len(learned)
    total, v = sum(c.values()), len(c)

    def brute(r):
        w = [*low(r[1]), None]
        return fold(r[0]) == 0, len(w), sum(c[x] > 0 for x in w), total, round(sum(log10((c[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w), 6)

    got = lm.score_documents(docs, hot=4).withColumn("base", F.round("base_score", 6))
    assert by_id(got, "held_out", "n_tokens", "n_known", "train_tokens", "base") == want(brute)
    assert got.where("score >= 0").count() == 0 and lm.score_documents(none).count() == 0
    # Prediction by partial matching, from all counts; the size of the broadcast cache changes nothing.
    lower = lambda r: (r[1] or "").encode().lower()
    marked = lambda r: bytes([lm.START]) * lm.ORDER + lower(r) + bytes([lm.STOP])
    after: dict[bytes, Counter] = {}
    for r in learned:
        m = marked(r)
        for i in range(lm.ORDER, len(m)):
            for j in range(lm.ORDER + 1):
                after.setdefault(m[i - j : i], Counter())[m[i]] += 1

    def chance(context: bytes, x: int) -> float:
        p, gone = 1.0, set()
        for j in range(len(context) + 1):
            if not (known := after.get(context[j:])):
                continue
            left = {y: n - lm.DISCOUNT for y, n in known.items() if y not in gone}
            whole = sum(left.values()) + lm.DISCOUNT * len(left)
            if x in left:
                return p * left[x] / whole
            p *= lm.DISCOUNT * len(left) / whole if left else 1
            gone |= set(known)
        return p / max(1, lm.SYMBOLS - len(gone))

    def ppm(r):
        m = marked(r)
        return (round(sum(log10(chance(m[i - lm.ORDER : i], m[i])) for i in range(lm.ORDER, len(m))), 6),)

    for options in ({}, {"runs": 100}, {"runs": 0}, {"part_runs": 40}):  # the last parts frequent pairs by a third byte
        got = lm.score_documents(docs, **options).withColumn("s", F.round("score", 6))
        assert by_id(got, "s") == want(ppm)
    for context in (b"", b"the", b"s an ", b"zzzzz"):
        assert abs(sum(chance(context, x) for x in range(256) if x != lm.START) - 1) < 1e-9


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    library = Tokenizer.from_file(path)

    def brute(r):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    encoded = bpe.encode_documents(docs, path)
    assert by_id(encoded, "n_tokens", "ids_sha256", "decoded_sha256") == want(brute)
    assert bpe.encode_documents(none, path).count() == 0
    text = {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded, path).collect()}
    assert text[103] == library.decode(library.encode("12 34 !!", add_special_tokens=False).ids, skip_special_tokens=False)
    own, rng = bpe.Bpe(open(path, encoding="utf-8").read()), random.Random(2)
    for alphabet in ([chr(i) for i in range(256)], list("aeinrstohl"), ["İ", "Σ", "ς", "é", "中", "😀", " ", "<|startoftext|>", "x"]):
        for _ in range(400):
            t = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
            assert own.encode(t)[0].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_language(docs, none):
    langs, logs = langid.train_fold(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, langs, logs, carry=("source",)).collect()}
    assert langs == ["en", "fr"] and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102, 103))
    right = [got[r[0]]["lang_pred"] == r[2] for r in corpus() if r[0] is not None and r[0] < 60 and len(split(r[1])) > 3]
    assert sum(right) / len(right) > 0.95 and got[0]["source"] == "s0"
    both = langid.mixtures(np.log(np.array([[0.9, 0.1]] * 30 + [[0.1, 0.9]] * 10)) * 20, np.array([0]), 3.0)
    assert abs(both[0, 0] - 0.75) < 0.01
    even = langid.mixtures(np.log(np.kron(np.eye(6), np.ones((80, 1))) + 0.01), np.array([0]), 3.0)
    assert np.allclose(even, 1 / 6, atol=0.01)  # six languages, none left out
    assert langid.identify(docs, [], np.zeros((1, 0))).where("lang_pred != 'und'").count() == 0
    assert langid.identify(none, *langid.train_fold(none)).count() == 0


def test_language_mixtures():
    """Proportions and the choice of the set against a plain loop over all nested sets, a word at a time."""
    rng = np.random.default_rng(5)
    for langs in (1, 2, 5, 9):
        for n in (1, 3, 30, 200):
            word = rng.normal(size=(n, langs)) * 3
            word[: n // 2, 0] += 4
            like = [[np.exp(x - max(w)) for x in w] for w in word]

            def em(share, like=like, n=n, langs=langs):
                for _ in range(langid.ROUNDS):
                    total = [0.0] * langs
                    for w in like:
                        whole = max(sum(x * s for x, s in zip(w, share, strict=True)), 1e-300)
                        total = [t + x * s / whole for t, x, s in zip(total, w, share, strict=True)]
                    share = [t / n for t in total]
                return share, sum(np.log(max(sum(x * s for x, s in zip(w, share, strict=True)), 1e-300)) for w in like)

            share, _ = em([1 / langs] * langs)
            order = sorted(range(langs), key=lambda i: (-share[i], i))
            sets = []
            for k in range(1, langs + 1):
                part = [share[i] if i in order[:k] else 0.0 for i in range(langs)]
                part, fitted = em([x / sum(part) for x in part])
                sets.append((fitted - 1.0 * k * np.log(n + 1), -k, part))
            assert np.allclose(langid.mixtures(word, np.array([0]), 1.0)[0], max(sets)[2], atol=1e-9)
    cells, words = rng.integers(0, 50, 3000), np.arange(0, 3000, 7)
    logs = rng.normal(size=(50, 3))
    whole = langid.word_likelihoods(cells, words, logs)
    assert np.allclose(whole, np.add.reduceat(logs[cells], words))


def test_op7_columns(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = langid.op7_language_id(spark, str(tmp_path)).collect()
    assert by_rows((r["doc_id"], r["held_out"]) for r in out) == by_rows((r[0], zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 4 == 2) for r in corpus())
    assert {r["lang_pred"] for r in out} == {"en", "fr", "und"} and all(0 <= r["score"] <= 1 for r in out)


def test_fingerprint(spark, docs, none):
    rows = sorted(corpus(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    nexts = [(r[0], r[1] or "", rows[(i + 1) % len(rows)][1] or "") for i, r in enumerate(rows)]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"], r["next"]) for r in fingerprint.with_next_text(docs).collect())
    assert got == sorted(((d is None, d or 0), t, n) for d, t, n in nexts)
    assert fingerprint.with_next_text(none).count() == 0
    for n in (0, 1, 2, 7, 40):
        bounds = sorted(random.Random(n).sample(range(60), n))
        ids = spark.range(60)
        assert [r[0] for r in ids.select(fingerprint.bisected(F.col("id"), bounds)).collect()] == [sum(b < i for b in bounds) for i in range(60)]


def brute_sketches(spark, texts: list[str]) -> list[tuple[list[int], int | None]]:
    """Hashes below a quarter of the range and the fallback, from Spark's hash of words and of their runs alone."""
    runs = []
    for t in texts:
        w = [x.decode() for x in split(t.lower())]
        runs.append([w[i : i + 5] for i in range(len(w) - 4)] if len(w) > 5 else [w] if w else [])
    flat = spark.createDataFrame([(i, r) for i, x in enumerate(runs) for r in x], "i int, r array<string>")
    words = F.transform("r", lambda w: F.xxhash64(w))
    hashed = F.when(F.size("r") < 5, F.xxhash64(words)).otherwise(F.xxhash64(*(F.get(words, F.lit(j)) for j in range(5))))
    got = [[] for _ in texts]
    for i, h, n in flat.select("i", hashed, F.size("r")).collect():
        got[i].append(h)
    low = [sorted({h for h in x if 0 <= h < 1 << 62}) for x in got]
    return [(a, min(x) if x and not a else None) for a, x in zip(low, got, strict=True)]


def test_fingerprint_sketch(spark):
    """Sketch, union and containment against brute force; a short text in a long one never reads as not contained."""
    rng = random.Random(8)
    long = " ".join(f"l{i}" for i in range(900))
    words = long.split()
    texts = [long, "", "one", "ONE two", "a b c d e", "Éa b c d e f"]
    for _ in range(80):
        at, n = rng.randrange(880), rng.randint(6, 18)
        texts.append(" ".join(words[at : at + n]))
    want = brute_sketches(spark, texts)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", fingerprint.sketch(F.col("t")).alias("s"))
    got = {r["i"]: (r["s"]["hashes"], r["s"]["least"]) for r in df.collect()}
    assert got == dict(enumerate(want))
    both = df.withColumn("whole", fingerprint.sketch(F.lit(long))).select("i", fingerprint.likeness(F.col("s"), F.col("whole")).alias("like"), fingerprint.merged(F.col("s"), F.col("whole")).alias("m"), fingerprint.likeness(F.col("s"), F.col("s")).alias("own"))
    for r in both.collect():
        hashes = want[r["i"]][0]
        assert (r["m"]["hashes"], r["m"]["least"]) == (sorted({*hashes, *want[0][0]}), None) and r["own"] == 1
        if r["i"] > 5:
            assert r["like"] == (1.0 if hashes else None)
    assert sum(1 for i in range(6, len(texts)) if not want[i][0]) > 3


def test_op8_columns(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = [r for r in fingerprint.op8_document_fingerprints(spark, str(tmp_path)).collect()]
    rows = sorted(corpus(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    key = lambda d, n, e: ((d is None, d or 0), n, e)
    assert sorted(key(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == sorted(key(r[0], len(t), hashlib.sha256(e.encode()).hexdigest()) for r, t, e in zip(rows, texts, edited, strict=True))
    own = {}
    for r, t in zip(rows, texts, strict=True):
        own[r[0]] = t
    prints = {r["doc_id"]: r["fingerprint"] for r in out}
    assert all((prints[a] == prints[b]) == (own[a] == own[b]) or not {len(split(own[a])), len(split(own[b]))} - {0} or split(own[a].lower()) == split(own[b].lower()) for a in own for b in own)
    assert all(0 <= r[c] <= 1 for r in out for c in ("near_edited", "near_next"))
    sets = lambda t: {tuple(w[i : i + 5]) for w in [split(t.lower())] for i in range(len(w) - 4)}
    exact = {r[0]: (sets(t), sets(e)) for r, t, e in zip(rows, texts, edited, strict=True)}
    errors = [r["near_edited"] - len(x & y) / min(len(x), len(y)) for r in out for x, y in [exact[r["doc_id"]]] if min(len(x), len(y)) > 50]
    assert len(errors) > 8 and max(map(abs, errors)) < 0.3 and abs(np.mean(errors)) < 0.08


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus())
    size = Counter()
    for r in corpus():
        size[r[3]] += len(split(r[1]))
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["times"] * r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["times"] <= 3 and r["source_size"] == size[r["source"]]
    left, free, level = float(sum(size.values())), sorted(size, key=lambda s: (s is None, s or "")), {}
    weight = {s: i % 3 + 1 for i, s in enumerate(free)}
    while True:
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if level[s] > 3 * size[s]]
        for s in free:
            want_target = 3 * size[s] if s in over else level[s]
            if s in over or not over:
                assert abs(target[s] - want_target) < 1e-6
        if not over:
            break
        left -= sum(3 * size[s] for s in over)
        free = [s for s in free if s not in over]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in size if s != "s0" and size[s] > 300), (taken, target)
    rows_of = lambda rows: sorted(str([r[c] for c in ("doc_id", "size", "source", "target", "mark", "times")]) for r in rows)
    assert rows_of(mixing.mix(docs.repartition(5)).collect()) == rows_of(got)
    assert mixing.mixed_documents(docs).count() == sum(r["times"] for r in got) and mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    clash = docs.selectExpr("doc_id", "text", "source", "lang m_own", "n_chars m_times", "lang no", "source size", "n_chars c0")
    taken = mixing.mixed_documents(clash)
    assert taken.columns == clash.columns
    assert sorted(map(str, taken.distinct().collect())) == sorted({str(r) for r in clash.collect() if r["text"] and r["text"].split()} & set(map(str, taken.collect()))) and taken.count() == sum(r["times"] for r in got)


def test_mixing_hot(spark):
    """Rows of one id and text, a third of all, are taken as others are."""
    rows = [(i if i % 3 else 0, "one two three" if i % 3 == 0 else " ".join(["w"] * (i % 7 + 1)), "a" if i % 2 else "b") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for hot in (1_000, 50):
        got = mixing.mix(df, hot=hot).collect()
        taken = Counter()
        for r in got:
            taken[r["source"]] += r["times"] * r["size"]
        assert len(got) == 900 and all(abs(taken[r["source"]] - r["target"]) <= 3 for r in got)


def test_fill():
    rng = random.Random(4)
    for _ in range(100):
        lengths = np.array(sorted(rng.sample(range(1, 60), 8)))
        counts = np.array([rng.randint(1, 5) for _ in lengths])
        budget = rng.randint(0, int(lengths @ counts))
        reach = {0}
        for s, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            reach = {r + k * s for r in reach for k in range(n + 1)}
        take = mixing.fill(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and int(lengths @ take) == max(r for r in reach if r <= budget)


def test_sharding(docs, none):
    clash = docs.withColumn("shard", F.lit("x"))
    got = sharding.shuffle_into_shards(clash).collect()
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str((r[0], r[1])) for r in corpus())
    again = sharding.shuffle_into_shards(docs.repartition(7)).collect()
    assert sorted(str((r["doc_id"], r["shard"], r["slot"])) for r in got if r["doc_id"] != 105) == sorted(str((r["doc_id"], r["shard"], r["slot"])) for r in again if r["doc_id"] != 105)
    assert sharding.shuffle_into_shards(none).count() == 0


def test_sharding_hot(spark):
    """Rows of one id and text, a third of all, don't share a bucket; slots stay gapless."""
    df = spark.createDataFrame([(0 if i % 3 == 0 else i, "same" if i % 3 == 0 else f"t{i}") for i in range(3000)], "doc_id long, text string")
    got = sharding.shuffle_into_shards(df, hot=100).collect()
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own))) and len(own) == 375
    assert sum(r["text"] == "same" for r in got) == 1000
    dealt = sharding.scattered(df.select(F.xxhash64("doc_id", "text").alias("mark"), "doc_id"), 24, 100).groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert dealt < 220


def test_op10_columns(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op10_sharding(spark, str(tmp_path)).collect()
    assert by_rows((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == by_rows((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}


def test_embedding(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    v = [(centres[i % 40] + rng.normal(size=16) * 0.05 * (i % 5)).tolist() for i in range(400)]
    rows = [(i, x, i % 40 % 3) for i, x in enumerate(v)] + [(400, v[0], 0), (401, None, 0), (402, [0.0] * 16, 0), (403, [float("nan")] * 16, 0), (404, v[0], None), (405, [1.0, 2.0], 1), (406, [None] + v[1][1:], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    sound = {i for i, x, label in rows if label is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x, _ in rows if i in sound}
    label = {i: x for i, _, x in rows}
    links = {i: {j for j in unit if i in unit and j != i and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93} for i in label}
    for block in (2000, 3):
        got = {r["vec_id"]: r for r in embedding.link_vectors(df, block=block).collect()}
        found = sum(r["n_links"] for r in got.values()) / sum(map(len, links.values()))
        assert len(got) == len(rows) and 0.9 <= found <= 1 and all(got[i]["n_links"] <= len(x) for i, x in links.items())
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(401, 407))
    assert embedding.link_vectors(df.where("false")).count() == 0


def test_embedding_dense_group(spark):
    """A third of the rows are near copies of one vector: no link is lost, whatever blocks and pivots there are."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 64))
    v[::3] = v[0] / np.linalg.norm(v[0]) + rng.normal(size=(500, 64)) * 0.027
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    like = v @ v.T >= 0.93
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    for pivots, block in ((None, 2000), (700, 200)):
        got = {r["vec_id"]: r["n_links"] for r in embedding.link_vectors(df, pivots=pivots, block=block).collect()}
        assert got == {i: int(x) - 1 for i, x in enumerate(like.sum(axis=1))}


def test_embedding_recall(spark):
    """Pairs at given cosines among vectors spread evenly over 64 dimensions: 0.99 or more are found, whatever number of pivots there is; none below the limit is."""
    rng = np.random.default_rng(3)
    n = 1000
    for cosine, pivots in ((0.931, 128), (0.931, 1024), (0.96, 2048), (0.9, 128)):
        v = rng.normal(size=(2 * n, 64))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        off = rng.normal(size=(n, 64))
        off -= (off * v[:n]).sum(axis=1, keepdims=True) * v[:n]
        v[n:] = cosine * v[:n] + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
        got = embedding.link_vectors(df, pivots=pivots).collect()
        found, all_links = sum(r["n_links"] for r in got), int((v @ v.T >= embedding.COSINE).sum()) - 2 * n
        assert 0.99 * all_links <= found <= all_links and (all_links > 0) == (cosine > 0.93)


def test_embedding_candidates():
    """Each pair that shares two pivots or more comes once, in the list of the first: by the product, and through the lists within the list."""
    rng = np.random.default_rng(4)
    for pivots, spread in ((12, 12), (2000, 9)):
        base = np.repeat(rng.integers(0, pivots - spread + 1, 40), 3)
        perms = np.array([np.append(0, rng.choice(np.arange(max(1, b), b + spread), 6, replace=False)) for b in base])
        for a, c in ((np.arange(120), np.arange(120)), (np.arange(50), np.arange(50, 120))):
            want = {(x, y) for x in a.tolist() for y in c.tolist() if (x < y or len(a) < 100) and len(set(perms[x]) & set(perms[y])) >= 2}
            got = [p for x, y in embedding.shared_pairs(0, perms, a, c) for p in zip(x.tolist(), y.tolist(), strict=True)]
            assert len(got) == len(set(got)) and set(got) == want
            assert not [p for x, y in embedding.shared_pairs(pivots + 1, perms, a, c) for p in x]


def test_license(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "plain text"), (3, "a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\nother words here"), (4, "d/z.py", "nothing of that"), (5, None, None), (6, "a/w", ""), (7, "e/LICENSE", "All rights reserved."), (8, "e/f/g", "text\nthe general public reads the terms")]
    got = {r["id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id", "path", "text").collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "MIT", "a"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, None, None), 5: (None, None, None), 6: (None, "MIT", "a"), 7: ("Proprietary", "Proprietary", None), 8: (None, "Proprietary", "e")}


def wrapped(text: str, width: int, mark: str = "") -> str:
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_license_files(spark):
    """Whole licences, and heads of long ones, make licence files by any name; a header never does, however short the code is."""
    of = {(name, kind): text for name, kind, text in license_templates.TEMPLATES}
    tail = wrapped("and so on with many more words about conditions of conveying modified source versions " * 40, 70)
    files = {n: f"Copyright (c) 2020 Some One\n\n{wrapped(of[n, 'text'], 74)}" for n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")}
    files |= {n: f"{wrapped(of[n, 'head'], 70)}\n\n{tail}" for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0")}
    rows = [(i, f"d{i}/TERMS", t) for i, t in enumerate(files.values())]
    system = Path("/usr/share/common-licenses")
    named = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}
    found = [(p, n) for p, n in named.items() if (system / p).exists()]
    rows += [(100 + i, f"s{i}/COPYING.txt", (system / p).read_text()) for i, (p, _) in enumerate(found)]
    headers = [(n, k, t) for n, k, t in license_templates.TEMPLATES if k == "notice"]
    rows += [(200 + i, f"h{i}/x.py", wrapped(t, 60, "# ") + "\n\nrun()") for i, (_, _, t) in enumerate(headers)]
    rows += [(300 + i, f"h{i}/sub/y.py", "no licence here") for i in range(len(headers))]
    rows += [(400, "d0/sub/z", "code"), (401, "q/x.js", "/*\n" + wrapped(of["MIT", "text"], 70, " * ") + "\n */\n" + "let value = compute(other, thing);\n" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(4)
    got = {r["id"]: r for r in license.scan_licenses(df, "doc_id", "path", "text").collect()}
    assert [(got[i]["own_license"], got[i]["is_license_file"]) for i in range(len(files))] == [(n, True) for n in files]
    assert [(got[100 + i]["own_license"], got[100 + i]["is_license_file"]) for i in range(len(found))] == [(n, True) for _, n in found]
    assert [(got[200 + i]["own_license"], got[200 + i]["is_license_file"]) for i in range(len(headers))] == [(n, False) for n, _, _ in headers]
    assert all(got[300 + i]["license"] is None for i in range(len(headers)))
    assert (got[400]["license"], got[400]["inherited_from"]) == ("MIT", "d0") and (got[401]["own_license"], got[401]["is_license_file"]) == ("MIT", False)
    assert max(max(u.values()) for u in license.fitted(license.TEMPLATES, license.LEAST)[0]) < license.LEAST  # no single word is enough


def test_license_brute(spark, none):
    """Scores of all stretches by plain TF-IDF over nulls, ties, repeats, very long texts and clashing columns."""
    rng = random.Random(6)
    notices = [t for _, k, t in license_templates.TEMPLATES if k != "text"]
    texts = [None, "", "\n\n", "mit", "license " * 30000, "\n".join(["Released under the MIT License."] * 3)]
    for i in range(40):
        words = rng.choice(notices).split()[:60]
        for _ in range(rng.randint(0, len(words) // 2)):
            words.insert(rng.randrange(len(words)), rng.choice(["the", "software", "zq", "license", "of"]))
        lines = [" ".join(words[j : j + 9]) for j in range(0, len(words), 9)]
        texts += ["\n".join(["some words"] * (i % 3) + lines)] * (1 + i % 2)
    units, idf, other, anchors = license.fitted(license.TEMPLATES, license.LEAST)
    names = [n for n, _, _ in license.TEMPLATES]

    def best(t):
        c = Counter(license.terms_of(t))
        length = sum((n * idf.get(w, other)) ** 2 for w, n in c.items()) ** 0.5
        return max(((round(sum(n * idf[w] * u.get(w, 0) for w, n in c.items() if w in idf) / length, 9) if length else 0.0), n) for u, n in zip(units, names, strict=True))

    def brute(t):
        lines, most = (t or "").split("\n"), (False, 0.0, None)
        for i, line in enumerate(lines):
            if set(license.terms_of(line)) & set(anchors):
                for k in (1, 2, 4, 8, 16, 32):
                    if k == 1 or i + k / 2 < len(lines):
                        score, name = best("\n".join(lines[i : i + k]))
                        if score >= license.LEAST and (name != license.RESERVED, score) > (most[0], most[1] + 1e-9):
                            most = (name != license.RESERVED, score, i)
        return most[1:]

    df = spark.createDataFrame([(i % 7 if i % 5 else None, f"p{i}", t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, file string, text string, license string, score double")
    got = {r["path"]: r for r in license.scan_licenses(df, "doc_id", "file", "text").collect()}
    assert len(got) == len(texts) and license.scan_licenses(none, "doc_id", "source", "text").count() == 0
    for i, t in enumerate(texts):
        score, line = brute(t)
        assert abs((got[f"p{i}"]["score"] or 0) - score) < 1e-6 and got[f"p{i}"]["line"] == line, (t, got[f"p{i}"], score, line)
    assert sum(r["own_license"] is not None for r in got.values()) > 20


def test_components(spark):
    e = [(1, 2), (2, 3), (5, 4), (4, 9), (7, 7), *((i, i + 1) for i in range(100, 140))]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert {k: got.get(k, k) for k in (1, 2, 3, 4, 5, 9, 7, 140)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 4, 7: 7, 140: 100}


def test_pipeline(spark, tmp_path):
    """Null and repeated ids included; each stage on its own input, and all of them."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = stages["language_id"](spark, docs, "").collect()
    assert {100, 101, 102, 103}.isdisjoint({r["doc_id"] for r in kept}) and len(kept) == len(corpus()) - 4
    once = stages["simhash_near_dedup"](spark, docs, "")
    rows = sorted(corpus(), key=lambda r: (r[0] is None, r[0] or 0))
    groups = near_groups([r[1] or f"empty{i}" for i, r in enumerate(rows)])
    expected = [r for i, r in enumerate(rows) if groups.get(i, i) == i]
    assert by_rows(tuple(r) for r in once.collect()) == by_rows(expected) and once.columns == corpus_pipeline.COLUMNS and len(expected) < len(rows) - 3
    cut = stages["substring_dedup"](spark, docs, "")
    mine = {(r["doc_id"], r["text"]) for r in substring.dedup_substrings(docs).where("n_words = 0 or n_removed < n_words").collect()}
    assert {(r["doc_id"], r["text"]) for r in cut.collect()} == mine and cut.columns == corpus_pipeline.COLUMNS
    mixed = stages["mixing"](spark, docs, "")
    assert mixed.count() == mixing.mix(docs).agg(F.sum("times")).first()[0] and mixed.columns == corpus_pipeline.COLUMNS
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.where("n_tokens is null").count() == 0 and whole.count() > 0
    left = docs
    for _, stage in corpus_pipeline.STAGES:
        left = spark.createDataFrame(stage(spark, left, "").collect(), stage(spark, left, "").schema)
    assert by_rows(map(str, whole.collect())) == by_rows(map(str, left.collect()))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_query_contracts(spark, tmp_path, docs):
    """Each query's columns and types, and the digests that only the queries make."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(i, [1.0, 0.1 * (i % 3), 0.0], i % 2) for i in range(9)] + [(9, None, 0), (None, [1.0, 0.0, 0.0], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want_types = {
        "op1_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        "op2_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op3_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
        "op4_license_scans": "doc_id bigint, path string, own_license string, score double, line int, is_license_file boolean, license string, inherited_from string",
        "op5_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
        "op6_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
        "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    }
    out = {}
    for name, types in want_types.items():
        df = queries.QUERIES[name](spark, str(tmp_path))
        assert {f"{c} {t}" for c, t in df.dtypes} >= set(types.split(", ")), (name, df.dtypes)
        out[name] = df.collect()
        assert len(out[name]) == (len(vectors) if name.startswith("op5") else len(corpus())), name
    digest = lambda b: hashlib.sha256(b).hexdigest()
    library = Tokenizer.from_file(bpe.default_tokenizer())
    coded = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in corpus()]
    assert by_rows((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out["op2_bpe"]) == by_rows((d, len(i), digest(" ".join(map(str, i)).encode()), digest(library.decode(i, skip_special_tokens=False).encode())) for d, i in coded)
    assert all(len(r["fingerprint"]) == 16 and int(r["fingerprint"], 16) >= 0 for r in out["op3_simhash_near_dedup"])
    cut = substring.dedup_substrings(docs).collect()
    assert by_rows((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out["op6_substring_dedup"]) == by_rows((r["doc_id"], r["n_words"], r["n_removed"], digest(r["text"].encode())) for r in cut)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out["op5_embedding_near_dedup"] if r["vec_id"] is not None)
    size = lambda t: len(split(t))
    assert by_rows((r["doc_id"], r["size"]) for r in out["op9_mixing"]) == by_rows((r[0], size(r[1])) for r in corpus())
    assert all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in out["op9_mixing"])
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    assert by_rows((r["doc_id"], r["held_out"], r["n_tokens"]) for r in out["op1_lm_scoring"]) == by_rows((r[0], fold(r[0]), size(r[1]) + 1) for r in corpus())
    assert len({r["train_tokens"] for r in out["op1_lm_scoring"]}) == 1 and all(r["score"] < 0 and r["base_score"] < 0 for r in out["op1_lm_scoring"])
