"""Raw queries over a stored index: phrases, prefix*, ^first, NEAR(a b, n), column: filters, AND, OR and NOT.

A query is a short parameter: it is read on the driver into leaves (a phrase, or some phrases near each other) and a condition
over them. All leaves of all queries are found in one pass over the postings of their stems; a prefix reads a range of the
sorted stems. What a chunk meets is a number with a bit for each leaf, so the condition needs no joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import store
from ..functions.porter import stem
from ..functions.text import word_tokens
from . import index

#: Fixed value: tokens that may stand between phrases of NEAR without a number.
NEAR = 10
MOST_LEAVES = 62
_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([\w\x1a]+)|([(){}:+*^,-]))')


@dataclass
class Phrase:
    texts: list[str]
    prefix: bool = False
    first: bool = False


@dataclass
class Leaf:
    phrases: list[Phrase]
    columns: frozenset[str] | None
    near: int = NEAR


@dataclass
class _Reader:
    """One query: NOT binds closer than AND, AND closer than OR, and phrases side by side closest, as AND."""

    text: str
    leaves: list[Leaf] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, end = 0, len(self.text.rstrip())
        while at < end:
            found = _TOKEN.match(self.text, at)
            if not found:
                raise ValueError(f"can't read {self.text[at:]!r}")
            at = found.end()
            quoted, word, mark = found.groups()
            self.tokens.append(("mark", mark) if mark else ("quoted", quoted.replace('""', '"')) if word is None else ("word", word))
        self.at = 0

    def peek(self, *what: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "quoted" and self.tokens[self.at][1] in what

    def take(self, *what: str) -> bool:
        met = self.peek(*what)
        self.at += met
        return met

    def need(self, what: str) -> None:
        if not self.take(what):
            raise ValueError(f"{what!r} is missing in {self.text!r}")

    def read(self):
        made = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"{self.tokens[self.at][1]!r} is out of place in {self.text!r}")
        return made

    def _left(self, below, word: str, name: str, columns):
        made = below(columns)
        while self.take(word):
            made = (name, made, below(columns))
        return made

    def either(self, columns: frozenset[str] | None = None):
        return self._left(self.both, "OR", "or", columns)

    def both(self, columns):
        return self._left(self.without, "AND", "and", columns)

    def without(self, columns):
        return self._left(self.beside, "NOT", "not", columns)

    def beside(self, columns):
        made = self.one(columns)
        while self.at < len(self.tokens) and not self.peek("AND", "OR", "NOT", ")"):
            made = ("and", made, self.one(columns))
        return made

    def one(self, columns: frozenset[str] | None):
        start = self.at
        if (names := self.filter()) is not None:
            away, named = names
            columns = (frozenset({"-"}) | named) if away else named if columns is None else columns & named
        else:
            self.at = start
        if self.take("("):
            made = self.either(columns)
            self.need(")")
            return made
        if self.peek("NEAR") and self.tokens[self.at + 1 : self.at + 2] == [("mark", "(")]:
            self.at += 2
            leaf = Leaf([self.phrase()], columns)
            while not self.peek(")", ","):
                leaf.phrases.append(self.phrase())
            if self.take(","):
                leaf.near = int(self.string())
            self.need(")")
        else:
            leaf = Leaf([self.phrase()], columns)
        self.leaves.append(leaf)
        return ("leaf", len(self.leaves) - 1)

    def filter(self) -> tuple[bool, frozenset[str]] | None:
        """Names before a colon: name:, {name name}: or either after a minus."""
        away, names = self.take("-"), []
        if self.take("{"):
            while not self.take("}"):
                names.append(self.string())
        elif self.at < len(self.tokens) and self.tokens[self.at][0] != "mark":
            names.append(self.string())
        return (away, frozenset(names)) if names and self.take(":") else None

    def string(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] == "mark" or self.peek("AND", "OR", "NOT"):
            raise ValueError(f"a word is missing in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def phrase(self) -> Phrase:
        made = Phrase([], first=self.take("^"))
        made.texts.append(self.string())
        while self.take("+"):
            made.texts.append(self.string())
        made.prefix = self.take("*")
        return made


def parse(text: str) -> tuple[list[Leaf], tuple]:
    """Leaves of a query, and the condition: ("leaf", no), ("and" | "or" | "not", condition, condition)."""
    reader = _Reader(text)
    made = reader.read()
    if len(reader.leaves) > MOST_LEAVES:
        raise ValueError(f"a query may hold {MOST_LEAVES} phrases")
    return reader.leaves, made


def _met(made: tuple, met: Column) -> Column:
    if made[0] == "leaf":
        return met.bitwiseAND(F.lit(1 << made[1])) != 0
    left, right = _met(made[1], met), _met(made[2], met)
    return left | right if made[0] == "or" else left & (~right if made[0] == "not" else right)


def _allowed(columns: frozenset[str] | None, names: tuple[str, ...]) -> list[int]:
    """Numbers of the columns that a filter lets through; a name that the index has not lets through none."""
    away = columns is not None and "-" in columns
    return [i for i, n in enumerate(names) if columns is None or (n in columns) != away]


def search(stored: index.Stored, queries: Iterable[tuple[int, str]], columns: tuple[str, str] = ("title", "content")) -> DataFrame:
    """query_id, chunk_id, score of every chunk that meets a query. ``columns`` name those of title and content.

    Every phrase that a chunk holds adds to its score, near ones only where they are near: a phrase's weight is by the chunks
    that hold it in its columns. Of a phrase without a letter or digit there are no hits."""
    spark = stored.spark
    read = [(qid, *parse(text)) for qid, text in queries]
    phrases = [(qid, no, p, leaf) for qid, leaves, _ in read for no, leaf in enumerate(leaves) for p in leaf.phrases]
    strings = spark.createDataFrame(pa.table({"id": pa.array(range(len(phrases)), pa.int32()), "text": pa.array([" ".join(p.texts) for _, _, p, _ in phrases], pa.string())}))
    words = {r["id"]: r["t"] for r in strings.select("id", word_tokens("text").alias("t")).collect()}
    exact, begins, facts = [], [], []
    for i, (qid, no, p, leaf) in enumerate(phrases):
        stems = [stem(w) for w in words[i]]
        facts.append((i, qid, no, len(leaf.phrases), leaf.near, len(stems), p.first, _allowed(leaf.columns, columns)))
        for at, s in enumerate(stems):
            (begins if p.prefix and at == len(stems) - 1 else exact).append((s, i, at))
    if len(exact) + len(begins) > index.MAX_TERMS:
        raise ValueError(f"a batch of queries may hold {index.MAX_TERMS} terms")
    schema = "phrase int, query_id long, leaf int, phrases int, near int, n int, first boolean, cols array<int>"
    known = F.broadcast(spark.createDataFrame(facts, schema))
    places = [stored.places([s for s, _, _ in exact]).join(F.broadcast(spark.createDataFrame(exact, "stem string, phrase int, no int")), "stem")]
    if begins:
        of = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(i).alias("phrase"), F.lit(at).alias("no")) for s, i, at in begins])
        places.append(stored.places([], [s for s, _, _ in begins]).withColumn("b", F.explode(F.filter(of, lambda b: F.startswith("stem", b["s"])))).select("stem", "chunk_id", "dl", "col", "pos", "b.phrase", "b.no"))
    rows = places[0] if len(places) == 1 else places[0].unionByName(places[1])
    # a word stands at each of its places; a place holds one word of a phrase at most, so that words are counted as rows
    one = F.col("phrase").isin([f[0] for f in facts if f[5] == 1])
    runs = rows.where(~one).groupBy("phrase", "chunk_id", "dl", "col", (F.col("pos") - F.col("no")).alias("start")).agg(F.count("*").alias("met"))
    runs = runs.unionByName(rows.where(one).select("phrase", "chunk_id", "dl", "col", F.col("pos").alias("start"), F.lit(1).cast("long").alias("met")))
    held = runs.join(known, "phrase").where((F.col("met") == F.col("n")) & F.array_contains("cols", F.col("col")) & (~F.col("first") | (F.col("start") == 0)))
    # of one leaf in one column of a chunk: how often each phrase stands there, and how often within a stretch of all
    each = held.where("phrases > 1").groupBy("query_id", "leaf", "phrases", "near", "chunk_id", "dl", "col").agg(F.collect_list(F.struct("phrase", "start", "n")).alias("at"))
    ids = F.array_distinct(F.transform("at", lambda a: a["phrase"]))
    within = lambda a, last: (a["start"] <= last) & (a["start"] + a["n"] + F.col("near") >= last)
    whole = lambda last: F.size(F.array_distinct(F.transform(F.filter("at", lambda a: within(a, last)), lambda a: a["phrase"]))) == F.col("phrases")
    lasts = F.when(F.size(ids) == F.col("phrases"), F.filter(F.array_distinct(F.transform("at", lambda a: a["start"])), whole))
    near = each.withColumn("lasts", lasts).select("query_id", "leaf", "phrases", "chunk_id", "dl", "col", "near", "lasts", F.explode("at").alias("a"))
    near = near.select("query_id", "leaf", F.col("a.phrase").alias("term"), "chunk_id", "dl", "col", F.coalesce(F.exists("lasts", lambda last: within(F.col("a"), last)), F.lit(False)).alias("ok"))
    # a leaf of one phrase has nothing to be near to: its places are not gathered
    every = near.unionByName(held.where("phrases = 1").select("query_id", "leaf", F.col("phrase").alias("term"), "chunk_id", "dl", "col", F.lit(True).alias("ok")))
    side = lambda c: F.count_if(F.col("ok") & (F.col("col") == c))
    # written, since hits are counted, scored and joined with their scores
    hits = store.kept(every.groupBy("query_id", "leaf", "term", "chunk_id", "dl").agg(side(0).alias("title_hits"), side(1).alias("content_hits")), "hits")
    scored = index.bm25(hits, stored.word_stats, ("query_id", "leaf")).join(hits, ["query_id", "leaf", "term", "chunk_id"]).where("title_hits + content_hits > 0")
    bit = F.expr("shiftleft(1L, leaf)")
    chunks = scored.groupBy("query_id", "chunk_id").agg(F.bit_or(bit).alias("met"), F.sum("score").alias("score"))
    meets = F.lit(False)
    for qid, _, made in read:
        meets |= (F.col("query_id") == qid) & _met(made, F.col("met"))
    return chunks.where(meets).select("query_id", "chunk_id", "score")
