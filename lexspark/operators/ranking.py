"""Query compilation, fusion, reranking, typo correction, diversification and entity boosts, for batches of queries."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon
from ..functions.porter import stem
from ..functions.text import WORD_EDGE, byte_levenshtein, col, trim
from . import index

#: The fusion constant, title boosts of prose and code, and the entity boost with its cap.
RRF_K, TITLE_PROSE, TITLE_CODE, ENTITY_BOOST, ENTITY_CAP = 60, 0.3, 0.6, 0.3, 5
_SPECIAL = r"""['"(){}\[\]*:^~]"""


def _literals(words) -> Column:
    return F.array(*map(F.lit, words))


def query_terms(query: Column | str) -> Column:
    """Lower-case words without search syntax and edge punctuation, each once; stopwords go unless all are."""
    words = F.split(trim(F.regexp_replace(col(query), _SPECIAL, " ")), r"[\t\n\x0B\f\r ]+")
    words = F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(".,!?;:")))), lambda w: w != ""))
    kept = F.filter(words, lambda w: ~w.isin(*sorted(lexicon.STOPWORDS)))
    return F.when(F.size(kept) == 0, words).otherwise(kept)


_SYNONYMS = json.dumps({t: list(lexicon.synonyms(t)) for g in lexicon.SYNONYM_GROUPS for t in g.split()})


def _synonyms(term: Column) -> Column:
    """The map is a constant that the optimizer works out once."""
    return F.coalesce(F.from_json(F.lit(_SYNONYMS), "map<string,array<string>>")[term], F.array().cast("array<string>"))


def word_groups(queries: DataFrame, expand: bool) -> DataFrame:
    """query_id, group_no, term: a query's groups of alternatives for the word index."""
    each = queries.select("query_id", F.posexplode(query_terms("query")).alias("group_no", "w"))
    each = each.where(~F.upper("w").isin(*lexicon.QUERY_KEYWORDS))
    alternatives = F.concat(F.array("w"), _synonyms(F.col("w"))) if expand else F.array("w")
    return each.select("query_id", "group_no", F.explode(alternatives).alias("term"))


def trigram_groups(queries: DataFrame, expand: bool) -> DataFrame:
    """As word_groups for the trigram index: pieces of 3 ASCII characters or more; synonyms of shorter ones count."""
    parts = F.filter(F.split(F.regexp_replace("w", "[^a-zA-Z0-9 _-]", " "), " +"), lambda p: p != "")
    each = queries.select("query_id", F.explode(query_terms("query")).alias("w")).select("query_id", F.explode(parts).alias("p"))
    each = each.select("query_id", (F.row_number().over(W.partitionBy("query_id").orderBy(F.lit(1))) - 1).alias("group_no"), "p")
    alternatives = F.concat(F.array("p"), F.transform(_synonyms(F.col("p")), lambda s: F.regexp_replace(s, "[^a-zA-Z0-9 _-]", ""))) if expand else F.array("p")
    long = F.filter(alternatives, lambda a: F.length(a) >= 3)
    return each.select("query_id", "group_no", F.explode(long).alias("term"))


def layer(groups: DataFrame, scored: DataFrame, every_group: bool) -> DataFrame:
    """query_id, chunk_id, score: the sum over all alternatives met; with ``every_group``, only where each group is met."""
    sizes = groups.groupBy("query_id").agg(F.count_distinct("group_no").alias("n"))
    met = F.broadcast(groups).join(scored, "term").groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"), F.count_distinct("group_no").alias("met"))
    if every_group:
        met = met.join(F.broadcast(sizes), "query_id").where("met = n")
    return met.select("query_id", "chunk_id", "score")


def top(ranked: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each query, with rank0 from 0."""
    order = W.partitionBy(*keys).orderBy("score", "chunk_id")
    # the planner knows a limit on row_number itself: each task passes on its k best of a query
    return ranked.withColumn("rank0", F.row_number().over(order)).where(F.col("rank0") <= k).withColumn("rank0", F.col("rank0") - 1)


def fuse(ranked: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Reciprocal rank fusion of rows keys, layer, chunk_id, score, rank0 by (source_id, title): the chunk with the best score
    of its own stands for its namesakes.

    keys, source_id, title, chunk_id, fused_score, layers, match_layer.
    """
    return fused(ranked.join(chunks.select("chunk_id", "source_id", "title"), "chunk_id"), keys)


def fused(named: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """As :func:`fuse`, of rows that have their source_id and title."""
    best = F.min_by("chunk_id", F.struct("score", "layer", "chunk_id")).alias("chunk_id")
    made = named.groupBy(*keys, "source_id", "title").agg(F.sum(1.0 / (RRF_K + F.col("rank0"))).alias("fused_score"), best, F.array_sort(F.collect_set("layer")).alias("layers"))
    # a single layer's best single rank is 1/60: more than that is taken for a hit in both
    tag = F.when(F.col("fused_score") > 1.0 / RRF_K, "rrf(porter+trigram)").otherwise(F.get("layers", F.lit(0)))
    return made.withColumn("match_layer", tag)


def title_boost(title: Column | str, content_type: Column | str, terms: Column | str) -> Column:
    terms = col(terms)
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(col(title)), t)))
    weight = F.when(col(content_type) == "code", TITLE_CODE).otherwise(TITLE_PROSE)
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(1.0 + weight * hits / F.size(terms))


def min_span(lists: list[list[int]]) -> int:
    """The shortest stretch that holds a position of each list: one sweep over all positions in order."""
    events = sorted((p, g) for g, ps in enumerate(lists) for p in ps)
    last: dict[int, int] = {}
    best = -1
    for p, g in events:
        last[g] = p
        if len(last) == len(lists) and (best < 0 or p - min(last.values()) < best):
            best = p - min(last.values())
    return best


def span_of(content: str, groups: list[list[str]], memo: dict[str, str] | None = None) -> int:
    """min_span in bytes of the matched words of each group; where a group has none, of all its substrings. -1: not all met.
    ``memo`` keeps the stems of words from one call to the next."""
    low, memo = content.lower(), {} if memo is None else memo

    def stemmed(w: str) -> str:
        if w not in memo:
            memo[w] = stem(w)
        return memo[w]

    stems = {stemmed(w) for g in groups for t in g for w in re.findall(r"[^\W_]+", t)}
    words = [(len(low[: m.start()].encode()), m[0]) for m in re.finditer(r"[^\W_]+", low) if stemmed(m[0]) in stems]
    lists = [[p for p, w in words if any(t in w for t in g)] for g in groups]
    if not all(lists):
        raw = low.encode()
        lists = [sorted(m.start() for t in g for m in re.finditer(b"(?=" + re.escape(t.encode()) + b")", raw)) for g in groups]
    return min_span(lists) if all(lists) else -1


@F.pandas_udf(T.DoubleType())
def proximity_boost(content: pd.Series, groups: pd.Series) -> pd.Series:
    """1 + 1 / (1 + span / length), for candidates of queries with two terms or more; else 1."""
    memo: dict[str, str] = {}

    def one(text: str, gs) -> float:
        lists = [list(g) for g in gs]
        span = span_of(text or "", lists, memo) if len(lists) > 1 else -1
        return 1.0 if span < 0 else 1.0 + 1.0 / (1.0 + span / max(len((text or "").encode()), 1))

    return pd.Series([one(t, g) for t, g in zip(content, groups, strict=True)], dtype=float)


def term_spans(positions: DataFrame, keys: list[str]) -> DataFrame:
    """As min_span in built-in functions: of rows keys, pos, group_no the keys and span. A start's span reaches to the
    farthest of the next positions of all groups; the least over all starts counts."""
    sizes = positions.groupBy(*keys).agg(F.collect_set("group_no").alias("gs"))
    rows = positions.join(sizes, keys)
    ahead = W.partitionBy(*keys).orderBy("pos").rangeBetween(W.currentRow, W.unboundedFollowing)
    later = F.collect_list(F.struct("group_no", "pos")).over(ahead)
    nexts = F.transform("gs", lambda g: F.array_min(F.transform(F.filter("later", lambda x: x["group_no"] == g), lambda x: x["pos"])))
    spans = rows.select(*keys, "pos", "gs", later.alias("later")).select(*keys, "pos", nexts.alias("nexts"))
    whole = spans.where(~F.exists("nexts", lambda x: x.isNull()))
    return whole.groupBy(*keys).agg(F.min(F.array_max("nexts") - F.col("pos")).alias("span"))


def correct(words: DataFrame, spellings: DataFrame) -> DataFrame:
    """word, fixed (null: none) of distinct words: the nearest vocabulary word within the allowed edits, the earliest of equals.

    Words of under 3 bytes, stopwords, words with synonyms and words of the vocabulary are left. ``spellings`` is that of
    :func:`index.spellings`: words meet those that share a part by equal keys, in the buckets of the words' keys."""
    left = sorted(lexicon.STOPWORDS | {t for g in lexicon.SYNONYM_GROUPS for t in g.split()})
    open_ = words.select("word").distinct().where((F.octet_length("word") >= 3) & ~F.col("word").isin(*left))
    probes = index.spelling_probes(open_).withColumnRenamed("word", "asked")
    on = ["key"]
    if "bucket" in spellings.columns:
        probes, on = probes.withColumn("bucket", index.bucket("key")), ["bucket", "key"]
    pairs = spellings.select(*on, F.col("word").alias("other"), "chunk_id", "no").join(probes, on).withColumn("distance", byte_levenshtein("asked", "other")).where("distance <= edits")
    # a word of the vocabulary finds itself, at distance 0
    best = pairs.groupBy(F.col("asked").alias("word")).agg(F.min(F.struct("distance", "chunk_id", "no", "other")).alias("x")).where("x.distance > 0")
    return words.select("word").distinct().join(best.select("word", F.col("x.other").alias("fixed")), "word", "left")


def correct_queries(queries: DataFrame, spellings: DataFrame) -> DataFrame:
    """query_id, query with words replaced; only queries that change."""
    cleaned = F.split(trim(F.regexp_replace(F.lower("query"), _SPECIAL, " ")), r"[\t\n\x0B\f\r ]+")
    words = queries.select("query_id", "query", F.posexplode(F.transform(cleaned, lambda w: F.btrim(w, F.lit(".,!?;:")))).alias("no", "word"))
    fixed = words.join(correct(words, spellings), "word", "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", F.coalesce("fixed", "word").alias("w")))), lambda x: x["w"]), " ")
    return fixed.groupBy("query_id").agg(text.alias("query"), F.count("fixed").alias("n")).where("n > 0").drop("n")


def diversify(results: DataFrame, limit: int, per_source: int = 2) -> DataFrame:
    """At most ``per_source`` results of a source in rank order, then the skipped ones, up to ``limit``. Needs query_id, rank."""
    nth = F.row_number().over(W.partitionBy("query_id", "source_id").orderBy("rank"))
    turn = results.withColumn("late", (nth > per_source).cast("int"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("late", "rank"))
    return turn.withColumn("place", place).where(F.col("place") <= limit).drop("late")


def entities(query: Column | str) -> Column:
    """Quoted phrases, then capitalised identifiers without the stop list and a plain sentence starter; each once."""
    query = col(query)
    phrases = F.filter(F.transform(F.regexp_extract_all(query, F.lit(r'"([^"]+)"'), F.lit(1)), trim), lambda p: F.octet_length(p) >= 2)
    rest = F.regexp_replace(query, r'"[^"]+"', " ")
    idents = F.regexp_extract_all(rest, F.lit(WORD_EDGE + r"[A-Z][a-zA-Z0-9_.\-]+" + WORD_EDGE), F.lit(0))
    signal = lambda x: x.rlike(r"[_.]|[a-z][A-Z]|[A-Z][A-Z][a-z]")
    starter = lambda x, i: (i == 0) & F.startswith(trim(rest), x) & ~signal(x)
    kept = F.filter(idents, lambda x, i: ~x.isin(*lexicon.ENTITY_STOPWORDS) & ~starter(x, i))
    return F.array_distinct(F.concat(phrases, F.filter(kept, lambda x: F.octet_length(x) >= 2)))


def entity_matches(content: Column | str, names: Column | str) -> Column:
    """Occurrences of all entities, up to the cap; phrases match in any case, single words exactly."""

    def count(e: Column) -> Column:
        flags = F.when(F.contains(e, F.lit(" ")), "(?i)").otherwise("")
        return F.regexp_count(col(content), F.concat(flags, F.lit(WORD_EDGE + r"\Q"), e, F.lit(r"\E" + WORD_EDGE)))

    total = F.aggregate(F.transform(col(names), count), F.lit(0), lambda a, b: a + b)
    return F.least(total, F.lit(ENTITY_CAP))


def entity_boost(content: Column | str, names: Column | str) -> Column:
    return 1.0 + ENTITY_BOOST * entity_matches(content, names)
