"""License scans: ordered signature rules over normalised words, in built-in functions only.

A text becomes its lower-cased words with one space between. A rule (see ``signatures``) is a regular expression over that, a
label, a keyword without which it isn't tried, and a priority. A detection is dropped if another one's words contain its own
and come first: by priority, then by length, then by the rules' order. Base rules are literal phrases; their detections stay.
Each expression is a literal of its own, so a task compiles it once; a detection is compared only with those that begin near it.

Defined cases: null and empty texts have no words, no labels and score 0; ids and other columns pass as they are, but for
columns that have the names of the results, which give way to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, packed, unpacked
from .signatures import STEMS, rules

#: What is not part of a word, in a text whose capitals are not folded yet.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases that are found wherever their words stand, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_DETECTION = "struct<begin:int,last:int,less:int,order:int,label:string,base:boolean>"


def words_of(text: Column) -> Column:
    """The words with a space before, between and after them; case is kept."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " ")), F.lit(" "))


def _quoted(x: str) -> str:
    escaped = x.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _marked(norm: str, phrases) -> Column:
    """For each rule the text with its matches between two marks, null where there is none."""
    one = "CASE WHEN contains({0}, {1}) AND {0} RLIKE {2} THEN regexp_replace({0}, {2}, '\\x01$0\\x02') END"
    one = one.replace("\\x01", "\x01").replace("\\x02", "\x02")
    every = ", ".join(one.format("x", _quoted(r.keyword), _quoted(r.pattern)) for r in rules(phrases))
    # inside a lambda, so that hundreds of branches don't become one generated method
    return F.expr(f"get(transform(array({norm}), x -> array({every})), 0)")


def _detections(marked: Column, phrases) -> Column:
    """array<_DETECTION> of words begin..last-1; ``less`` is the negative priority."""
    made = rules(phrases)
    column = lambda values, kind: F.split(F.lit("|".join(map(str, values))), r"\|").cast(f"array<{kind}>")
    labels, less, base = column((r.label for r in made), "string"), column((-r.priority for r in made), "int"), column((r.base for r in made), "int")

    def found(text: Column, i: Column) -> Column:
        words = F.split(text, " ")
        at = lambda mark, shift: F.filter(F.transform(words, lambda w, k: F.when(mark(w), k + shift)), lambda k: k.isNotNull())
        begins, n = at(lambda w: F.startswith(w, F.lit("\x01")), -1), F.get(base, i)
        ends = F.when(n > 0, F.transform(begins, lambda b: b + n)).otherwise(at(lambda w: F.endswith(w, F.lit("\x02")), 0))
        row = lambda b, e: F.struct(b.alias("begin"), e.alias("last"), F.get(less, i).alias("less"), i.alias("order"), F.get(labels, i).alias("label"), (n > 0).alias("base"))
        return F.when(text.isNotNull(), F.zip_with(begins, ends, row))

    return F.flatten(F.filter(F.transform(marked, found), lambda x: x.isNotNull())).cast(f"array<{_DETECTION}>")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def suppressed(all_: Column) -> Column:
    """The detections that stay, in order of begin. They are cut into blocks of as many words as the longest one has (64 at least): what
    contains a detection begins in its own block or the one before, so only those are compared."""
    size = lambda x: x["last"] - x["begin"]
    rank = lambda x: F.struct(-x["less"], size(x), -x["order"])
    before = lambda e, d: (e["begin"] <= d["begin"]) & (e["last"] >= d["last"]) & (rank(e) > rank(d))

    def kept(own: Column, earlier: Column) -> Column:
        return F.filter(own, lambda d: d["base"] | ~(F.exists(own, lambda e: before(e, d)) | F.coalesce(F.exists(earlier, lambda e: before(e, d)), F.lit(False))))

    def cut(found: Column, starts: Column) -> Column:
        """Blocks of detections in order, from the (one-based) places where they start."""
        return F.transform(starts, lambda s, k: F.slice(found, s, F.coalesce(F.get(starts, k + 1), F.size(found) + 1) - s))

    def sorted_(found: Column) -> Column:
        reach = F.greatest(F.lit(64), F.array_max(F.transform(found, size)))
        numbers = _let(reach, lambda n: F.transform(found, lambda d: F.floor(d["begin"] / n).cast("int")))
        starts = _let(numbers, lambda ns: F.transform(F.array_distinct(ns), lambda b: F.array_position(ns, b).cast("int")))
        blocks = _let(starts, lambda at: cut(found, at))
        return _let(blocks, lambda bs: F.flatten(F.transform(bs, lambda own, k: kept(own, F.get(bs, k - 1)))))

    return _let(F.array_sort(all_), sorted_)


def scan(docs: DataFrame, text: str = "text", phrases=PHRASES) -> DataFrame:
    """The columns of ``docs``, n_words_ and detections_: those that stay after suppression, null where no rule was tried."""
    own = [c for c in docs.columns if c not in ("n_words_", "detections_")]
    n_words = F.when(F.length("bare") <= 2, F.lit(0)).otherwise(F.length("bare") - F.length(F.replace("bare", F.lit(" "))) - 1)
    some = reduce(lambda a, b: a | b, [F.contains("low", F.lit(g)) for g in (*STEMS, *(phrase for phrase, _ in phrases))])
    held = packed(docs, words_of(F.col(f"`{text}`")).alias("bare"))
    gated = held.select("row", "bare", F.lower("bare").alias("low"), n_words.cast("long").alias("n_words"))
    gated = gated.select("row", "n_words", F.when(some, ascii_lower(F.col("bare"))).alias("norm"))
    marked = gated.select("row", "n_words", F.when(F.col("norm").isNotNull(), _marked("norm", phrases)).alias("marked"))
    found = marked.select("row", "n_words", F.when(F.col("marked").isNotNull(), _detections(F.col("marked"), phrases)).alias("all"))
    kept = found.select("row", "n_words", F.when(F.size("all") > 0, suppressed(F.col("all"))).alias("detections"))
    return unpacked(kept, own, F.col("n_words").alias("n_words_"), F.col("detections").alias("detections_"))


def digest(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), "text", phrases)
    base = F.filter("detections_", lambda d: d["base"])
    names = lambda x: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda d: d["label"]))), ","), F.lit(""))
    begins = F.transform(base, lambda d: d["begin"])
    score = F.coalesce(F.array_max(F.transform("detections_", lambda d: d["less"] / -100)), F.lit(0.0))
    n_base = F.when(F.col("detections_").isNull(), F.lit(0)).otherwise(F.size(base)).cast("long")
    return found.select(
        "doc_id", F.col("n_words_").alias("n_words"), n_base.alias("n_base"), F.array_min(begins).cast("long").alias("first_word"), F.array_max(begins).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(F.col("detections_")).alias("labels"), score.cast("double").alias("score"),
    )
