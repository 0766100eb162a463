"""License scans, in DataFrame functions only.

The words of a stretch of lines make a sparse TF-IDF vector, weights fitted on
the templates; its cosine to each template decides which licence the stretch
states. Stretches start at lines that hold a template's anchor and have 1 to
LONGEST lines, doubling, so that wrapped headers are found, in comments too, as
marks are no words.

A licence file is one that is named so and states a licence, one whose whole
text is much like a licence text, or one that opens with the head of a long one. A
notice alone never makes a source file a licence file. Its licence holds for its
directory: a file that states none inherits from the nearest directory above it,
by joins of paths.

Most texts have no licence words. By the inequality of Cauchy and Schwarz a
stretch is at most as like a template as the share of the template's length that
lies in words which the stretch has. So a text is read by lines only if it has
enough of some template's words, and a stretch starts only at a line that has
one of the *anchors*, words without which no template can be reached. Where a
stretch that is like a template has its first anchor after its first line, a
later start is like it less the lines without anchors.

Defined cases: null and empty texts state nothing; a null path has no directory
and inherits nothing; among equally like templates the licence that sorts first,
and among equally like stretches the first and then the shortest, is reported;
reserved rights count only where no licence is stated, as many licences reserve
them; a directory with several licence files has the most like, then the first by path.
Repeated rows and null ids stay. A text of any length is one row, read by lines;
an empty table gives an empty one. Only the three columns named are read, under
names of their own.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, table
from .license_templates import COMMON, ORDINARY, TEMPLATES

LEAST, LONGEST = 0.75, 32
#: How like a licence a whole text must be to be a licence file, if its name doesn't say so.
WHOLE = 0.9
#: A head opens a licence file if it starts in one of so many lines.
OPENING = 4
#: Stated beside many licences: it counts where nothing else is found.
RESERVED = "Proprietary"
#: The most that a rare word weighs: no single word of a template makes a stretch like it.
MOST_IDF = 3.0
_TERM = "[a-z0-9]+"
#: Names of licence files.
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[cs]es?|copying|copyright)(?:[-_.][^/]*)?$"


def terms_of(text: str) -> list[str]:
    return [w for w in re.findall(_TERM, text.lower()) if w not in COMMON]


def fitted(templates: list[tuple[str, str, str]], least: float) -> tuple[list[dict[str, float]], dict[str, float], float, list[str]]:
    """Unit vectors of the templates, weights of their words and of any other word, and the anchors."""
    terms = [Counter(terms_of(text)) for _, _, text in templates]
    seen = Counter(w for c in terms for w in c)
    idf = {w: min(MOST_IDF, log((1 + len(terms)) / (1 + n)) + 1) for w, n in seen.items()}
    units, anchors = [], set()
    for c in terms:
        length = sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        unit = {w: n * idf[w] / length for w, n in c.items()}
        rest = 1.0
        for w in sorted(unit, key=lambda w: (w.isdigit(), w in ORDINARY, -unit[w], w)):
            if rest < (least - 1e-9) ** 2:
                break
            anchors.add(w)
            rest -= unit[w] ** 2
        units.append(unit)
    return units, idf, MOST_IDF, sorted(anchors)


def any_of(words: list[str]) -> str:
    """A pattern of all words, by common beginnings, so that few of them are tried at each place."""

    def branch(tails: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for t in tails:
            if t:
                by.setdefault(t[0], []).append(t[1:])
        options = [k + branch(v) for k, v in sorted(by.items())]
        whole = options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")" if options else ""
        return f"(?:{whole})?+" if whole and "" in tails else whole

    return "(?i)\\b" + branch(sorted(set(words))) + "\\b"


def most_like(words: Column, templates: list[tuple[str, str, str]]) -> Column:
    """(score, first, license, kind) of the template most like an array of words, in one row: nothing is exploded or shuffled.

    Sorted, equal words lie together, so one pass sums the squares of their
    counts; template words are counted apart. transform(array(x), f)[0] names x.
    """
    vectors, idf, other, _ = fitted(templates, LEAST)
    order = sorted(range(len(templates)), key=lambda i: templates[i][0])
    vocab = F.lit(sorted(idf))
    # Constants, folded to one value each.
    weights = F.from_json(F.lit(json.dumps({w: [idf[w] * vectors[k].get(w, 0.0) for k in order] for w in sorted(idf)})), "map<string,array<double>>")
    more = F.from_json(F.lit(json.dumps({w: idf[w] ** 2 - other**2 for w in sorted(idf)})), "map<string,double>")
    names = F.from_json(F.lit(json.dumps([{"first": -i, "license": templates[k][0], "kind": templates[k][1]} for i, k in enumerate(order)])), "array<struct<first:int,license:string,kind:string>>")
    words = F.filter(words, lambda w: ~F.array_contains(F.lit(COMMON), w))

    def squares(ordered: Column) -> Column:
        start = F.struct(F.lit("").alias("word"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sum"))

        def step(s: Column, w: Column) -> Column:
            n = F.when(s.word == w, s.n + 1).otherwise(F.lit(1).cast("long"))
            return F.struct(w.alias("word"), n.alias("n"), (s.sum + 2 * n - 1).alias("sum"))  # the first n odd numbers sum to n squared

        return F.aggregate(ordered, start, step, lambda s: s.sum)

    def counts(own: Column) -> Column:
        return F.transform(F.array_distinct(own), lambda w: F.struct(w.alias("word"), (F.size(own) - F.size(F.array_remove(own, w))).cast("double").alias("tf")))

    def scored(c: Column) -> Column:
        square = F.aggregate(c.own, c.squares * F.lit(other**2), lambda s, x: s + x.tf * x.tf * F.element_at(more, x.word))
        products = F.aggregate(c.own, F.array(*(F.lit(0.0) for _ in order)), lambda s, x: F.zip_with(s, F.element_at(weights, x.word), lambda p, w: p + x.tf * w))
        return F.struct(F.sqrt(square).alias("length"), products.alias("products"))

    def best(c: Column) -> Column:
        return F.array_max(F.zip_with(c.products, names, lambda p, k: F.struct(F.coalesce(F.round(p / F.nullif(c.length, F.lit(0.0)), 9), F.lit(0.0)).alias("score"), k["first"].alias("first"), k["license"].alias("license"), k["kind"].alias("kind"))))

    sums = let(F.sort_array(words), lambda s: F.struct(squares(s).alias("squares"), F.filter(s, lambda w: F.array_contains(vocab, w)).alias("own")))
    return let(let(let(sums, lambda c: F.struct(c.squares.alias("squares"), counts(c.own).alias("own"))), scored), best)


def let(x: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def enough(words: Column, templates: list[tuple[str, str, str]], least: float) -> Column:
    """Does a text with these words hold a stretch that may be like a template?"""
    vectors, idf, _, anchors = fitted(templates, least)
    shares = F.from_json(F.lit(json.dumps({w: [v.get(w, 0.0) ** 2 for v in vectors] for w in sorted(idf)})), "map<string,array<double>>")
    covered = lambda own: F.aggregate(own, F.array(*(F.lit(0.0) for _ in vectors)), lambda s, w: F.zip_with(s, F.element_at(shares, w), lambda a, b: a + b))
    held = lambda w: F.when(F.arrays_overlap(w, F.lit(anchors)), F.array_max(covered(F.array_intersect(w, F.lit(sorted(idf))))) >= least**2 - 1e-9)
    return F.coalesce(let(words, held), F.lit(False))


def directories(path: Column) -> Column:
    """The directories above a path, nearest first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def scan_licenses(files: DataFrame, id_col: str, path_col: str, text_col: str, templates: list[tuple[str, str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """(id, path, own_license, score, line, is_license_file, license, inherited_from).

    own_license is stated by the file; license is that, or the one inherited from
    the directory inherited_from. Ids need not be distinct.
    """
    templates = templates or TEMPLATES
    pattern = any_of(fitted(templates, least)[3])
    texts = [t for t in templates if t[1] == "text"]
    files = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"({_TERM})"), 1)
    lengths = [1 << k for k in range(LONGEST.bit_length())]

    def stretches(lines: Column) -> Column:
        """(grants, score, before, shorter, license, kind) of each stretch that starts at an anchor and is like a template."""
        starts = F.filter(F.transform(lines, lambda t, i: F.when(t.rlike(pattern), i)), lambda i: i.isNotNull())
        spans = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: (n == 1) | (i + n / 2 < F.size(lines))), lambda n: F.struct(i.alias("line"), n.alias("lines")))))
        like = F.transform(spans, lambda s: F.struct(most_like(terms(F.array_join(F.slice(lines, s["line"] + 1, s["lines"]), "\n")), templates).alias("best"), s["line"].alias("line"), s["lines"].alias("lines")))
        return F.transform(F.filter(like, lambda x: x["best"]["score"] >= least), lambda x: F.struct((x["best"]["license"] != RESERVED).alias("grants"), x["best"]["score"].alias("score"), (-x["line"]).alias("before"), (-x["lines"]).alias("shorter"), x["best"]["license"].alias("license"), x["best"]["kind"].alias("kind")))

    may = F.col("may")
    files = files.withColumn("may", enough(F.split(F.lower("text"), "[^a-z0-9]+"), templates, least))
    found = files.select("id", "path", F.when(may, stretches(F.split("text", "\r\n|\n|\r"))).alias("like"), *([F.when(may, most_like(terms(F.col("text")), texts)).alias("whole")] if texts else []))
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    whole = F.when((F.col("whole.score") >= WHOLE) | named & (F.col("whole.score") >= least), F.struct(F.col("whole.score").alias("score"), F.col("whole.license").alias("license"))) if texts else F.lit(None).cast("struct<score:double,license:string>")
    opening = F.array_max(F.filter("like", lambda x: (x["kind"] == "head") & (x["before"] > -OPENING)))
    stated = F.array_max("like")
    found = found.select("id", "path", stated.alias("stated"), whole.alias("whole"), F.struct(opening["score"].alias("score"), opening["license"].alias("license")).alias("opening"), named.alias("named"))
    of_file = lambda c: F.coalesce(F.col(f"whole.{c}"), F.col(f"opening.{c}"), F.when(F.col("named"), F.col(f"stated.{c}")))
    found = found.select("id", "path", F.coalesce(of_file("license"), F.col("stated.license")).alias("own_license"), F.coalesce(of_file("score"), F.col("stated.score")).alias("score"), (-F.col("stated.before")).alias("line"), of_file("license").isNotNull().alias("is_license_file"), of_file("score").alias("file_score"))
    found = materialise(found)  # without the texts; three steps read it
    holders = found.where("is_license_file").select(F.get(directories(F.col("path")), F.lit(0)).alias("dir"), F.struct((-F.col("file_score")).alias("s"), "path", F.col("own_license").alias("license")).alias("h")).where("dir is not null")
    holders = holders.groupBy("dir").agg(F.min("h").alias("h")).select("dir", "h.license")
    # The directories that files without a licence lie in are few beside the files; each asks its ancestors.
    asked = found.where("own_license is null").select(F.get(directories(F.col("path")), F.lit(0)).alias("place")).where("place is not null").distinct()
    steps = asked.select("place", F.posexplode(F.concat(F.array("place"), F.coalesce(directories(F.col("place")), F.array().cast("array<string>")))).alias("step", "dir"))
    nearest = steps.join(holders, "dir").groupBy("place").agg(F.min(F.struct("step", "dir", "license")).alias("h")).select("place", F.col("h.dir").alias("inherited_from"), F.col("h.license").alias("inherited"))
    found = found.withColumn("place", F.when(F.col("own_license").isNull(), F.get(directories(F.col("path")), F.lit(0))))
    out = found.join(nearest, "place", "left")
    return out.select("id", "path", "own_license", "score", "line", "is_license_file", F.coalesce("own_license", "inherited").alias("license"), "inherited_from")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source is a directory, with a subdirectory for each hundred ids."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.expr("cast(doc_id div 100 as string)"), F.col("doc_id").cast("string"))
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text").withColumnRenamed("id", "doc_id")
