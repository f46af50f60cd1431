"""The whole search: fused word and trigram passes, fallbacks, typo correction, diversification and entity boost."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property, reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import store
from ..operators import index, ranking

#: Kinds of sources, and those searched unless a search says otherwise.
KINDS, DEFAULT_KINDS = ("ephemeral", "durable", "session"), ("durable", "session")


@dataclass(frozen=True)
class Options:
    """source: a label, or part of one in any case (``exact`` tells), in which % and _ are wildcards; naming one lifts the kind filter."""

    limit: int = 10
    source: str = ""
    exact: bool = False
    content_type: str = ""
    kinds: tuple[str, ...] = field(default=())
    per_source: int = 2
    #: "intent": a query's groups of synonyms are ANDed. "flat": with two terms or more and a synonym among them, straight to OR.
    compat: str = "intent"


def include_kinds(raw: list[str]) -> tuple[str, ...]:
    """Checked and each once."""
    kinds = tuple(dict.fromkeys(k.strip().lower() for k in raw if k.strip()))
    if wrong := [k for k in kinds if k not in KINDS]:
        raise ValueError(f"unknown kind {wrong[0]!r}: kinds are {', '.join(KINDS)}")
    return kinds


def effective_kinds(options: Options) -> tuple[str, ...] | None:
    """None: no filter."""
    return None if options.source else options.kinds or DEFAULT_KINDS


def scope_includes(options: Options, kind: str) -> bool:
    kinds = effective_kinds(options)
    return kinds is None or kind in kinds


def source_filter(options: Options) -> Column:
    """Over label, kind and content_type."""
    found = F.lit(True)
    if (kinds := effective_kinds(options)) is not None:
        found &= F.col("kind").isin(*kinds)
    if options.source and options.exact:
        found &= F.col("label") == options.source
    elif options.source:
        found &= F.col("label").ilike("%" + options.source.replace("\\", "\\\\") + "%")
    if options.content_type:
        found &= F.col("content_type") == options.content_type
    return found


class Corpus:
    """Chunks (chunk_id, source_id, chunk_no, title, content, content_type) and sources (source_id, label, kind), with what
    a search needs of them; each search goes through all chunks. :class:`Indexed` is for more than a few searches."""

    def __init__(self, chunks: DataFrame, sources: DataFrame):
        self.chunks, self.sources = chunks, sources

    @cached_property
    def spellings(self) -> DataFrame:
        return index.spellings(index.vocabulary(self.chunks))

    @cached_property
    def word_stats(self) -> tuple[int, float]:
        return index.word_stats(self.chunks)

    @cached_property
    def trigram_stats(self) -> tuple[int, float]:
        return index.trigram_stats(self.chunks)

    def word_hits(self, terms: DataFrame | Iterable[str]) -> DataFrame:
        return index.word_hits(self.chunks, terms)

    def trigram_hits(self, terms: DataFrame | Iterable[str]) -> DataFrame:
        return index.trigram_hits(self.chunks, terms)

    def texts(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Rows with a chunk_id, and columns of their chunks."""
        return self.chunks.select("chunk_id", *columns).join(rows, "chunk_id")

    def scoped(self, hits: DataFrame, options: Options) -> DataFrame:
        """The hits in sources and chunks that a search is for."""
        inside = self.chunks.join(self.sources.select("source_id", "label", "kind"), "source_id").where(source_filter(options))
        return hits.join(inside.select("chunk_id"), "chunk_id", "left_semi")


class Indexed(Corpus):
    """A corpus over a stored index: a search reads the postings of its terms and the chunks that it shows."""

    def __init__(self, stored: index.Stored, sources: DataFrame):
        super().__init__(stored.read("chunks").drop("bucket"), sources)
        self.stored, self.texts = stored, stored.texts
        self.word_hits, self.trigram_hits = stored.word_hits, stored.trigram_hits

    @cached_property
    def spellings(self) -> DataFrame:
        return self.stored.read("spellings")

    @property
    def word_stats(self) -> tuple[int, float]:
        return self.stored.word_stats

    @property
    def trigram_stats(self) -> tuple[int, float]:
        return self.stored.trigram_stats

    def scoped(self, hits: DataFrame, options: Options) -> DataFrame:
        if options.content_type:
            return super().scoped(hits, options)
        inside = self.sources.where(source_filter(options)).select("source_id")
        return hits.withColumn("source_id", index.source_of("chunk_id")).join(inside, "source_id", "left_semi").drop("source_id")


def _compiled(queries: DataFrame, options: Options) -> tuple[DataFrame, dict[str, set[str]], int]:
    """The terms of each layer, the largest group_no, and the table layer, strict, query_id, group_no, term, n (groups of the query there): one small job, then a local table.

    strict 1: groups of synonyms, all of which must be met; 0: any of the query's own terms."""
    makers = {"porter": ranking.word_groups, "trigram": ranking.trigram_groups}
    parts = [make(queries, every).select(F.lit(name).alias("layer"), F.lit(int(every)).alias("strict"), "query_id", F.col("group_no").cast("long").alias("group_no"), "term") for name, make in makers.items() for every in (True, False)]
    rows = [tuple(r) for r in reduce(DataFrame.union, parts).limit(4 * index.MAX_TERMS + 1).collect()]
    if len(rows) > 4 * index.MAX_TERMS:
        raise ValueError(f"a batch of queries may hold {index.MAX_TERMS} terms")
    sizes: dict[tuple, set] = {}
    terms: dict[tuple, int] = {}
    for layer, strict, query_id, group_no, _ in rows:
        sizes.setdefault((layer, strict, query_id), set()).add(group_no)
        terms[layer, strict, query_id] = terms.get((layer, strict, query_id), 0) + 1
    if options.compat == "flat":
        rows = [r for r in rows if not r[1] or len(sizes[r[:3]]) in (1, terms[r[:3]])]
    names = ["layer", "strict", "query_id", "group_no", "term"]
    cols = list(zip(*rows, strict=True)) or [()] * 5
    made = {n: pa.array(c, pa.string() if n in ("layer", "term") else pa.int64()) for n, c in zip(names, cols, strict=True)}
    made["n"] = pa.array([len(sizes[r[:3]]) for r in rows], pa.int64())
    return queries.sparkSession.createDataFrame(pa.table(made)), {name: {r[4] for r in rows if r[0] == name} for name in makers}, max((r[3] for r in rows), default=0)


def _pass(corpus: Corpus, queries: DataFrame, options: Options) -> DataFrame:
    """Fused and reranked candidates: query_id, chunk_id, source_id, title, fused_score, layers, match_layer, rank.

    The strict groups count where they find anything, else the flat ones. Both indexes and both modes go through one plan."""
    groups, of, widest = _compiled(queries, options)
    hits = [corpus.word_hits(of["porter"]).withColumn("layer", F.lit("porter")), corpus.trigram_hits(of["trigram"]).withColumn("layer", F.lit("trigram"))]
    # written, since they are counted before they are scored
    with index.small_batches(queries.sparkSession):
        hits = store.kept(hits[0].unionByName(hits[1]), "hits")
    (n, words), (_, grams) = corpus.word_stats, corpus.trigram_stats
    scored = index.bm25(hits, (n, F.when(F.col("layer") == "porter", words).otherwise(grams)), ("layer",))
    keys = ("query_id", "strict", "layer")
    # rounded, so that the order of equal scores is not that of their summation
    score = F.round(F.sum("score"), 9).alias("score")
    # a chunk's hits are dealt to one task before they are joined with the queries, which have many more rows in all: they are
    # summed up there, in as many parts as shuffles have, and a group that was met is a bit of as many words as there are groups for
    dealt = scored.repartition(int(corpus.chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id")
    bits = [F.bit_or(F.when(F.floor(F.col("group_no") / 62) == w, F.expr("shiftleft(1L, cast(group_no % 62 as int))")).otherwise(F.lit(0).cast("long"))) for w in range(widest // 62 + 1)]
    met = F.broadcast(groups).join(dealt, ["layer", "term"]).groupBy(*keys, "n", "chunk_id").agg(score, reduce(add, [F.bit_count(b) for b in bits]).alias("met"))
    best = ranking.top(corpus.scoped(met.where("strict = 0 or met = n"), options), max(5 * options.limit, 10), keys)
    both = ranking.fused(corpus.texts(best, "source_id", "title"), ("query_id", "strict"))
    either = both.withColumn("best", F.max("strict").over(W.partitionBy("query_id"))).where("strict = best").drop("strict", "best")
    terms = ranking.query_terms("query")
    groups = F.transform(terms, lambda t: F.concat(F.array(t), ranking._synonyms(t)))
    wide = either.join(F.broadcast(queries.select("query_id", terms.alias("terms"), groups.alias("groups"))), "query_id")
    wide = corpus.texts(wide, "content", "content_type")
    boost = ranking.title_boost("title", "content_type", "terms") * ranking.proximity_boost("content", "groups")
    order = W.partitionBy("query_id").orderBy(F.desc("fused_score"), "source_id", "title")
    reranked = wide.withColumn("fused_score", F.round(F.col("fused_score") * boost, 9)).withColumn("rank", F.row_number().over(order))
    return reranked.drop("terms", "groups")


def search(corpus: Corpus, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """query_id, rank, source_id, label, title, content, fused_score, match_layer: at most ``limit`` results of each query."""
    # at most 4 x 5 x limit rows of each query are written and read again: of them the later steps are made
    primary = store.kept(_pass(corpus, queries, options).withColumn("phase", F.lit(0)), "primary")
    counts = primary.groupBy("query_id").agg(F.count("*").alias("n"))
    needy = queries.join(F.broadcast(counts), "query_id", "left").where(F.coalesce("n", F.lit(0)) < options.limit).select("query_id", "query")
    results = primary
    if not needy.isEmpty():
        fixed = store.kept(ranking.correct_queries(needy, corpus.spellings), "corrected")
        if not fixed.isEmpty():
            second = _pass(corpus, fixed, options).withColumn("phase", F.lit(1)).withColumn("match_layer", F.concat(F.lit("fuzzy+"), "match_layer"))
            second = second.join(primary.select("query_id", "source_id", "title"), ["query_id", "source_id", "title"], "left_anti")
            results = primary.unionByName(second)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("phase", "rank"))
    spread = ranking.diversify(results.withColumn("rank", rank), options.limit, options.per_source)
    names = queries.select("query_id", ranking.entities("query").alias("names"))
    boosted = spread.join(F.broadcast(names), "query_id").withColumn("fused_score", F.col("fused_score") * ranking.entity_boost("content", "names"))
    # results are sorted anew only where the query has entities
    last = W.partitionBy("query_id").orderBy(F.when(F.size("names") > 0, -F.col("fused_score")).otherwise(F.lit(0.0)), "place")
    ranked = boosted.withColumn("rank", F.row_number().over(last))
    return ranked.join(corpus.sources.select("source_id", "label"), "source_id").select("query_id", "rank", "source_id", "label", "title", "content", "fused_score", "match_layer")
