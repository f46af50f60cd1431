"""The catalogue: a query per operator, over whole tables. Scores are rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import store
from ..functions import coerce, text
from ..operators import access, chunking, evaluate, folders, highlights, index, lifecycle, policy, ranking, segments, sessions, snippets, vault
from ..sources import files, pages
from ..streaming import archive, state
from . import search, tables

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}

QUERIES = ((1, "general public license"), (2, "Apache License version"), (3, "pathetic idiot"), (4, "mit license released"))
TYPOS = ((11, "licnese apache"), (12, "pathetik moron"), (13, "genral pubic license"), (14, "error log thandsnd"))


def query(f: Query) -> Query:
    ALL[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(text.col(c), 6)


def sha(c: Column | str) -> Column:
    return F.sha2(text.col(c).cast("binary"), 256)


def _batch(spark: SparkSession, rows=QUERIES) -> DataFrame:
    ids, texts = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table({"query_id": pa.array(ids, pa.int32()), "query": pa.array(texts)}))


def _corpus(spark: SparkSession, sf: str) -> search.Corpus:
    return search.Indexed(tables.stored_index(spark, sf), tables.bare_sources(spark, sf))


# -- text to chunks ---------------------------------------------------------------------------------------------------


@query
def redact_secrets(spark, sf):
    docs = tables.read(spark, sf, "documents")
    return docs.select("doc_id", "text", text.redact("text").alias("out")).select("doc_id", sha("out").alias("redacted_sha"), (F.col("out") != F.col("text")).alias("changed"))


@query
def content_hash_dedup(spark, sf):
    hashed = tables.read(spark, sf, "documents").select("doc_id", lifecycle.content_hash("text").alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query
def size_guard_rejects(spark, sf):
    return lifecycle.size_guard(tables.read(spark, sf, "documents"), most=10_000)[1].select("doc_id", F.col("bytes").cast("long").alias("bytes"))


@query
def detect_content_type(spark, sf):
    part = lambda name, column: tables.read(spark, sf, name).select(F.lit(name).alias("of"), F.coalesce(column, F.lit("")).alias("x"))
    every = part("documents", "text").union(part("events", "props")).union(part("pages", "html"))
    return every.select("of", chunking.content_type(F.col("x")).alias("kind")).groupBy("of", "kind").agg(F.count("*").alias("n"))


@query
def chunk_plaintext(spark, sf):
    return tables.chunks(spark, sf).select("source_id", "chunk_no", "title", sha("content").alias("content_sha"))


@query
def chunk_code_flag(spark, sf):
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```py\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return tables.read(spark, sf, "documents").select("doc_id", chunking.has_code(fenced).alias("has_code"))


@query
def chunk_markdown(spark, sf):
    return pages.page_chunks(tables.read(spark, sf, "pages"))


@query
def chunk_json(spark, sf):
    orders = tables.read(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total")))).alias("orders"))
    customers = tables.read(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    nested = customers.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "orders")).alias("x"))
    parts = nested.select("c_custkey", F.posexplode(chunking.json_text_chunks(F.col("x"), 1024)).alias("chunk_no", "c"))
    return parts.select("c_custkey", "chunk_no", "c.title", "c.content")


@query
def html_to_markdown(spark, sf):
    return tables.read(spark, sf, "pages").select("page_id", pages.html_to_markdown("html").alias("markdown"))


# -- vocabulary and statistics ------------------------------------------------------------------------------------------


@query
def vocabulary(spark, sf):
    return index.vocabulary(tables.chunks(spark, sf))


@query
def doc_frequency(spark, sf):
    return index.doc_frequency(tables.chunks(spark, sf))


@query
def distinctive_terms(spark, sf):
    return index.distinctive_terms(tables.kept_chunks(spark, sf, "source_id", "content")).withColumn("score", r6("score"))


@query
def index_stats(spark, sf):
    """Builds the stored index, if this session has none yet."""
    stored = tables.stored_index(spark, sf)
    return stored.read("sizes").agg(F.sum("n").alias("n"), r6(F.sum("words") / F.sum("n")).alias("words"), r6(F.sum("grams") / F.sum("n")).alias("grams"))


# -- ranking --------------------------------------------------------------------------------------------------------------


def _scored(spark, sf, kind: str, groups: DataFrame) -> DataFrame:
    stored = tables.stored_index(spark, sf)
    terms = groups.select("term")
    return index.bm25(stored.word_hits(terms), stored.word_stats) if kind == "word" else index.bm25(stored.trigram_hits(terms), stored.trigram_stats)


def _layer(spark, sf, kind: str, every: bool, expand: bool = False) -> DataFrame:
    groups = (ranking.word_groups if kind == "word" else ranking.trigram_groups)(_batch(spark), expand)
    ranked = ranking.layer(groups, _scored(spark, sf, kind, groups), every).withColumn("score", F.round("score", 9))
    return ranking.top(ranked, 20)


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", F.col("rank0").cast("int").alias("rank0"), "chunk_id", r6("score").alias("score"))


@query
def bm25_word_topk(spark, sf):
    return _shown(_layer(spark, sf, "word", False, True))


@query
def bm25_word_and(spark, sf):
    return _shown(_layer(spark, sf, "word", True))


@query
def bm25_word_or(spark, sf):
    return _shown(_layer(spark, sf, "word", False))


@query
def bm25_trigram_topk(spark, sf):
    return _shown(_layer(spark, sf, "trigram", False))


def _fused(spark, sf) -> DataFrame:
    ranked = _layer(spark, sf, "word", False).withColumn("layer", F.lit("porter")).unionByName(_layer(spark, sf, "trigram", False).withColumn("layer", F.lit("trigram")))
    return ranking.fused(tables.stored_index(spark, sf).texts(ranked, "source_id", "title"))


@query
def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "source_id", "title", r6("fused_score").alias("fused_score"), F.array_join("layers", ",").alias("layers"), "match_layer")


@query
def title_boost(spark, sf):
    chunks = tables.chunks(spark, sf)
    terms = _batch(spark).select("query_id", ranking.query_terms("query").alias("terms"))
    pairs = chunks.where(F.col("title") != "Output").select("chunk_id", "title", F.when(F.col("chunk_no") % 2 == 0, "code").otherwise("prose").alias("content_type"))
    # a stated batch of queries against all titles: the batch is an array beside each, boosts of 1 go
    batch = F.array(*[F.struct(F.lit(r.query_id).alias("query_id"), F.array(*map(F.lit, r.terms)).alias("terms")) for r in terms.collect()])
    rated = F.transform(batch, lambda q: F.struct(q["query_id"].alias("query_id"), ranking.title_boost("title", "content_type", q["terms"]).alias("boost")))
    each = pairs.select("chunk_id", F.explode(F.filter(rated, lambda x: x["boost"] > 1)).alias("x"))
    return each.select("x.query_id", "chunk_id", r6("x.boost").alias("boost"))


@query
def diversify(spark, sf):
    c = tables.chunks(spark, sf).select(F.lit(1).alias("query_id"), "source_id", "chunk_id", F.length("content").alias("n"))
    # of a source at most as many as are shown can count: the others go before all sources meet in one window
    nth = F.row_number().over(W.partitionBy("query_id", "source_id").orderBy(F.desc("n"), "chunk_id"))
    best = c.withColumn("nth", nth).where("nth <= 50")
    late = (F.col("nth") > 2).cast("int")
    few = best.withColumn("late", late).orderBy("late", F.desc("n"), "chunk_id").limit(50)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "chunk_id")))
    return ranking.diversify(ranked, 50, 2).select("query_id", "source_id", "chunk_id", F.col("place").cast("int").alias("place"))


def _scope(spark, sf, options: search.Options) -> DataFrame:
    return tables.bare_sources(spark, sf).withColumn("content_type", F.lit("prose")).where(search.source_filter(options)).select("source_id", "label", "kind")


@query
def kind_filter(spark, sf):
    return _scope(spark, sf, search.Options())


@query
def source_filter(spark, sf):
    return _scope(spark, sf, search.Options(source="DOC:1_"))


@query
def proximity_span(spark, sf):
    """The shortest stretch, in words, that holds all words of a query."""
    groups = ranking.word_groups(_batch(spark), False)
    tokens = index.postings(tables.chunks(spark, sf), groups.select("term")).where("col = 1")
    # written, since it is read four times and the chunks would be made as often
    at = store.kept(tokens.join(F.broadcast(groups), "term").select("query_id", "chunk_id", "group_no", "pos"), "places")
    sizes = groups.groupBy("query_id").agg(F.count_distinct("group_no").alias("n"))
    full = at.groupBy("query_id", "chunk_id").agg(F.count_distinct("group_no").alias("met")).join(F.broadcast(sizes), "query_id").where("met = n").select("query_id", "chunk_id")
    return ranking.term_spans(at.join(full, ["query_id", "chunk_id"], "left_semi"), ["query_id", "chunk_id"])


@query
def snippet_windows(spark, sf):
    docs = tables.read(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    hits = docs.select(F.col("doc_id").alias("id"), F.length("text").alias("length"), F.explode(snippets.positions("text", F.array(F.lit("license")))).alias("pos"))
    return snippets.window_rows(hits).select("id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end_"))


@query
def highlight(spark, sf):
    """The best 20 chunks of each query by words and their synonyms, with marks around what it hits: their bytes, the shortest
    stretch that holds one of each group, and the text."""
    groups = ranking.word_groups(_batch(spark), True)
    stored = tables.stored_index(spark, sf)
    scored = index.bm25(stored.word_hits(groups.select("term")), stored.word_stats)
    best = ranking.top(ranking.layer(groups, scored, False).withColumn("score", F.round("score", 9)), 20)
    lists = groups.groupBy("query_id", "group_no").agg(F.collect_list("term").alias("g")).groupBy("query_id").agg(F.collect_list("g").alias("groups"))
    found = highlights.marks(stored, best, groups).join(F.broadcast(lists), "query_id")
    marked = found.withColumn("text", highlights.highlighted("content", "marks"))
    at = F.array_join(F.transform("marks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return marked.select("query_id", "chunk_id", at.alias("marks"), highlights.span("content", "marks", "groups").alias("span"), sha("text").alias("text_sha"), (highlights.stripped("text") == F.col("content")).alias("strips"))


@query
def synonym_expand(spark, sf):
    """Each user's message of a conversation as a query: its terms with their synonyms."""
    said = tables.read(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return ranking.word_groups(said, True).select("query_id", F.col("group_no").cast("int").alias("group_no"), "term")


@query
def and_or_fallback(spark, sf):
    """All groups where any chunk holds them, else any group."""
    batch = ((1, "general public license"), (5, "pathetic apache"), (6, "idiot general scum trash loser"))
    groups = ranking.word_groups(_batch(spark, batch), False)
    scored = _scored(spark, sf, "word", groups)
    strict, flat = ranking.layer(groups, scored, True), ranking.layer(groups, scored, False)
    both = strict.withColumn("mode", F.lit("and")).union(flat.join(strict.select("query_id").distinct(), "query_id", "left_anti").withColumn("mode", F.lit("or")))
    return both.select("query_id", "chunk_id", "mode", r6("score").alias("score"))


@query
def fuzzy_correct(spark, sf):
    words = _batch(spark, TYPOS).select(F.explode(F.split(F.lower("query"), " ")).alias("word")).distinct()
    return ranking.correct(words, tables.stored_index(spark, sf).read("spellings"))


@query
def entity_extract(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", F.posexplode(ranking.entities(F.coalesce("text", F.lit("")))).alias("no", "entity"))
    return docs.select("doc_id", F.col("no").cast("int").alias("no"), "entity")


@query
def entity_boost(spark, sf):
    names = F.array(F.lit("MIT"), F.lit("Apache License"), F.lit("Public"))
    rated = tables.read(spark, sf, "documents").select("doc_id", ranking.entity_matches("text", names).alias("n"))
    return rated.where("n > 0").select("doc_id", r6(1.0 + ranking.ENTITY_BOOST * F.col("n")).alias("boost"))


@query
def porter_search(spark, sf):
    """All groups of each query, by stems."""
    return _shown(_layer(spark, sf, "word", True, True))


@query
def full_search_pipeline(spark, sf):
    found = search.search(_corpus(spark, sf), _batch(spark, QUERIES + TYPOS), search.Options(limit=10))
    return found.select("query_id", "rank", "source_id", "title", r6("fused_score").alias("fused_score"), "match_layer")


# -- lifecycle --------------------------------------------------------------------------------------------------------------


@query
def retention_tiers(spark, sf):
    rated = lifecycle.classify(tables.sources(spark, sf), tables.as_of()).where("kind = 'durable'")
    return rated.select("source_id", "tier", r6("retention_score").alias("retention_score"))


@query
def ttl_buckets(spark, sf):
    return lifecycle.classify(tables.sources(spark, sf), tables.as_of()).where("kind <> 'durable'").groupBy("kind", "tier").agg(F.count("*").alias("n"))


def _sized(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Sources and chunks, written: no stage makes them while it joins them."""
    chunks = tables.kept_chunks(spark, sf, "source_id", "content")
    return store.kept(tables.sources(spark, sf, chunks), "sources"), chunks


def _candidates(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    return lifecycle.eviction_candidates(sources, chunks, tables.as_of(), most=20_000)


@query
def cleanup_candidates(spark, sf):
    return _candidates(*_sized(spark, sf)).select("source_id", "eviction_reason")


@query
def eviction_breakdown(spark, sf):
    return _candidates(*_sized(spark, sf)).groupBy("kind", "eviction_reason").agg(F.count("*").alias("n"))


@query
def evict_apply(spark, sf):
    sources, chunks = _sized(spark, sf)
    left, pieces = lifecycle.evict(sources, chunks, store.kept(_candidates(sources, chunks).select("source_id"), "gone"))
    return left.join(pieces.groupBy("source_id").agg(F.count("*").alias("chunks")), "source_id", "left").select("source_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query
def kb_stats(spark, sf):
    return lifecycle.stats(tables.sources(spark, sf), tables.chunks(spark, sf), tables.as_of(), tables.stored_index(spark, sf).read("vocabulary"))


@query
def sources_newest(spark, sf):
    return lifecycle.newest(tables.bare_sources(spark, sf), 100).select("source_id", "label")


@query
def chunks_of_source(spark, sf):
    return lifecycle.chunks_of(tables.bare_sources(spark, sf), tables.chunks(spark, sf), "doc:10").select("chunk_no", "title", sha("content").alias("content_sha"))


@query
def section_inventory(spark, sf):
    return lifecycle.section_inventory(tables.chunks(spark, sf)).select("source_id", sha("inventory").alias("inventory_sha"))


@query
def retag_sources(spark, sf):
    kinds = F.array(*map(F.lit, ("execute:", "file:", "batch:", "doc:")))
    labelled = tables.bare_sources(spark, sf).withColumn("label", F.concat(F.element_at(kinds, (F.col("source_id") % 4 + 1).cast("int")), F.col("source_id").cast("string")))
    return lifecycle.retag(labelled).select("label", "kind")


@query
def exit_classes(spark, sf):
    n = F.col("event_id")
    runs = tables.read(spark, sf, "events").select(F.when(n % 2 == 0, "shell").otherwise("python").alias("language"), (n % 3).cast("int").alias("code"), F.when(n % 5 == 0, " ").otherwise("out").alias("stdout"))
    return runs.groupBy("language", "code", "stdout", lifecycle.exit_class(F.col("language"), F.col("code"), F.col("stdout")).alias("class")).agg(F.count("*").alias("n"))


@query
def kind_sizes(spark, sf):
    return lifecycle.kind_sizes(tables.bare_sources(spark, sf), tables.chunks(spark, sf))


@query
def top_sources(spark, sf):
    return lifecycle.top_sources(tables.bare_sources(spark, sf), tables.chunks(spark, sf)).select("label", "content_bytes", "chunk_rows")


@query
def oversized(spark, sf):
    return lifecycle.oversized(tables.bare_sources(spark, sf), tables.chunks(spark, sf), 15_000).select("source_id", "content_bytes")


def _incoming(spark, sf) -> DataFrame:
    """Documents indexed anew: some with other text, some of another kind, some under new labels, some twice."""
    d = F.col("doc_id")
    changed = F.when(d % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    kind = F.when(d % 4 == 2, "durable").otherwise(F.element_at(F.array(*map(F.lit, ("durable", "ephemeral", "session"))), (d % 3 + 1).cast("int")))
    name = F.when(d % 4 == 3, F.concat(F.lit("new:"), (d % 50).cast("string"))).otherwise(F.concat(F.lit("doc:"), d.cast("string")))
    return tables.read(spark, sf, "documents").select(name.alias("label"), kind.alias("kind"), lifecycle.content_hash(changed).alias("content_hash"), d.alias("seq"))


@query
def index_upsert_plan(spark, sf):
    return lifecycle.upsert_plan(_incoming(spark, sf), tables.bare_sources(spark, sf)).select("label", "action", "seq")


def _segments(spark, sf) -> segments.Segments:
    """All documents; then all again, some with other text, some of another kind, some under new labels, a tenth deleted.
    Written at the first call of a session."""
    docs = tables.read(spark, sf, "documents")
    d, text_ = F.col("doc_id"), F.coalesce("text", F.lit(""))
    kind = F.element_at(F.array(*map(F.lit, ("durable", "ephemeral", "session"))), (d % 3 + 1).cast("int"))
    label = F.concat(F.lit("doc:"), d.cast("string"))
    again = F.when(d % 4 == 3, F.concat(F.lit("new:"), (d % 50).cast("string"))).otherwise(label)
    changed = F.when(d % 10 != 0, F.concat(text_, F.when(d % 4 == 1, F.lit(" license!")).otherwise("")))
    batches = (
        docs.select(label.alias("label"), kind.alias("kind"), text_.alias("text"), d.alias("seq")),
        docs.select(again.alias("label"), F.when(d % 4 == 2, "durable").otherwise(kind).alias("kind"), changed.alias("text"), d.alias("seq")),
    )

    def write(at: str) -> None:
        made = segments.Segments(spark, at)
        for number, rows in enumerate(batches):
            made.apply(number, rows, tables.as_of())

    return segments.Segments(spark, store.once(spark, "segments", sf, write))


@query
def index_segments(spark, sf):
    """Hits of words in an index of two segments, with the labels of their sources."""
    made = _segments(spark, sf)
    groups = ranking.word_groups(_batch(spark), False)
    stored = made.open()
    hits = ranking.layer(groups, index.bm25(stored.word_hits(groups.select("term")), stored.word_stats), False).withColumn("source_id", index.source_of("chunk_id"))
    return hits.join(made.sources(), "source_id").select("query_id", "label", (F.col("chunk_id") % 2**20).cast("int").alias("chunk_no"), r6("score").alias("score"))


@query
def segment_actions(spark, sf):
    """What each segment did to labels, and how many sources of a kind live in the end."""
    made = _segments(spark, sf)
    log = made.log().groupBy(F.col("segment").cast("string").alias("of"), F.col("action").alias("what")).agg(F.count("*").alias("n"))
    return log.unionByName(made.sources().groupBy(F.lit("alive").alias("of"), F.col("kind").alias("what")).agg(F.count("*").alias("n")))


@query
def index_upsert_apply(spark, sf):
    have = tables.sources(spark, sf).select("source_id", "label", "kind", "content_hash", "indexed_at", "last_accessed_at", "access_count")
    new = lifecycle.apply_upsert(have, lifecycle.upsert_plan(_incoming(spark, sf), have), tables.as_of())
    return new.select("source_id", "label", "kind", "content_hash", F.col("access_count").cast("long").alias("access_count"))


@query
def fetch_cache_hits(spark, sf):
    wanted = tables.bare_sources(spark, sf).select("label", F.when(F.col("source_id") % 2 == 0, F.col("kind")).otherwise("ephemeral").alias("kind"))
    return lifecycle.fetch_cache(wanted, tables.bare_sources(spark, sf), tables.as_of(), 240).select("label", "hit")


@query
def access_tracking(spark, sf):
    events = tables.read(spark, sf, "events")
    log = events.select((F.col("event_id") % 1000).alias("search_id"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("at"))
    have = tables.bare_sources(spark, sf).withColumns({"access_count": F.lit(0).cast("long"), "last_accessed_at": F.col("indexed_at")})
    return access.track(have, log).select("source_id", "access_count")


@query
def smart_truncate(spark, sf):
    docs = tables.read(spark, sf, "documents").where(F.octet_length("text") > 2000)
    return docs.select("doc_id", sha(lifecycle.smart_truncate("text", 2000)).alias("cut_sha"))


# -- sessions -----------------------------------------------------------------------------------------------------------------


def _pairs(spark, sf) -> DataFrame:
    return sessions.turn_pairs(tables.messages(spark, sf))


@query
def turn_pairs(spark, sf):
    return _pairs(spark, sf).select("session", F.col("pair_no").cast("int").alias("pair_no"), sha("human").alias("human_sha"), sha("assistant").alias("assistant_sha"))


@query
def session_indexable(spark, sf):
    return sessions.indexable(_pairs(spark, sf)).select("session", "pairs", "assistant_bytes", "indexable")


@query
def transcript_render(spark, sf):
    return sessions.transcripts(sessions.render_pairs(_pairs(spark, sf))).select("session", "pairs", sha("transcript").alias("transcript_sha"))


def _windows(spark, sf) -> DataFrame:
    return sessions.windows(sessions.render_pairs(_pairs(spark, sf)), tables.starts(spark, sf), most=1500, split=False)


@query
def session_windows(spark, sf):
    return _windows(spark, sf).select("session", F.col("chunk_no").cast("int").alias("chunk_no"), sha("content").alias("content_sha"))


@query
def session_titles(spark, sf):
    return _windows(spark, sf).select("session", F.col("chunk_no").cast("int").alias("chunk_no"), "title")


@query
def session_chunks(spark, sf):
    """Windows with the oversized ones split at blank lines."""
    rendered = sessions.render_pairs(_pairs(spark, sf))
    return sessions.windows(rendered, tables.starts(spark, sf), most=1500).select("session", F.col("chunk_no").cast("int").alias("chunk_no"), "title", F.octet_length("content").alias("bytes"))


@query
def subagent_blocks(spark, sf):
    """The second half of each session's pairs belong to two subagents."""
    pairs = _pairs(spark, sf)
    agents = pairs.where("pair_no >= 1").select("*", F.concat(F.lit("a"), (F.col("pair_no") % 3).cast("string")).alias("agent_id"), F.lit("explore").alias("agent_type"), F.lit('find "it"').alias("agent_description"))
    both = sessions.with_subagents(pairs.where("pair_no < 1"), agents)
    return sessions.transcripts(sessions.render_pairs(both)).select("session", "pairs", sha("transcript").alias("transcript_sha"))


@query
def session_log_pairs(spark, sf):
    """The same pairs from JSON log lines."""
    parsed = sessions.parse_lines(tables.log_lines(spark, sf))
    pairs = sessions.turn_pairs(sessions.messages(parsed))
    return pairs.select("session", F.col("pair_no").cast("int").alias("pair_no"), sha("human").alias("human_sha"), F.size("tools").alias("tools"))


# -- archive ------------------------------------------------------------------------------------------------------------------


def _archive_rows(spark, sf) -> DataFrame:
    return vault.messages(sessions.parse_lines(tables.log_lines(spark, sf)))


@query
def vault_messages(spark, sf):
    return _archive_rows(spark, sf).select("session", F.col("turn_index").cast("int").alias("turn_index"), F.col("message_index").cast("int").alias("message_index"), F.col("line_no").cast("int").alias("line_no"), "role", sha("text").alias("text_sha"))


def _archive(spark, sf) -> DataFrame:
    c = tables.read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"), F.sum(F.octet_length("text")).alias("size_bytes"))
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("conv_id") * 3_600_000_000)
    project = F.concat(F.lit("/home/p"), (F.col("conv_id") % 7).cast("string"))
    return c.select(F.format_string("%08d-aaaa", "conv_id").alias("session"), "message_count", "size_bytes", at.alias("start_time"), F.when(F.col("conv_id") % 5 > 0, F.timestamp_micros(F.unix_micros(at) + 60_000_000)).alias("end_time"), project.alias("project_path"), F.concat(F.lit("m"), (F.col("conv_id") % 2).cast("string")).alias("machine_id"), sha(F.col("size_bytes").cast("string")).alias("content_hash"), at.alias("archived_at"))


@query
def vault_import_status(spark, sf):
    have = _archive(spark, sf)
    n = F.substring("session", 1, 8).cast("int")
    incoming = have.select(F.when(n % 4 == 0, F.concat(F.lit("n"), "session")).otherwise(F.col("session")).alias("session"), F.when(n % 4 == 1, F.col("content_hash")).otherwise(sha("session")).alias("content_hash"), (F.col("size_bytes") + F.when(n % 4 == 2, -1).otherwise(1)).alias("size_bytes"))
    return vault.import_plan(incoming, have, tables.as_of()).select("session", "status")


@query
def archive_import(spark, sf):
    """Conversations as session logs, imported twice: two thirds of them first, a seventh of which can't be read; then all, half
    of those mended. What stands in the archive then, and what is set apart."""
    lines = tables.log_lines(spark, sf).groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("log"))
    n = F.col("session").cast("long")
    logs = store.kept(lines.select("session", F.lit("-srv").alias("project_dir"), F.lit("").alias("relative_path"), "log"), "logs")
    of = lambda poisoned: logs.select("session", "project_dir", "relative_path", F.when(poisoned, "no log").otherwise(F.col("log")).cast("binary").alias("content"))
    made = archive.Archive(spark, store.path(spark, "archive"))
    made.apply(0, of(n % 7 == 3).where(n % 3 != 2), tables.as_of())
    made.apply(1, of((n % 7 == 3) & (n % 2 == 1)), F.timestamp_micros(F.unix_micros(tables.as_of()) + 86_400_000_000))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "message_index", "text"))), lambda x: x["text"]), "\n")
    said = made.messages().groupBy("session").agg(F.count("*").alias("messages"), sha(texts).alias("text_sha"))
    kept = made.sessions().join(said, "session", "left").select("session", F.lit("archived").alias("state"), F.coalesce("messages", F.lit(0)).alias("messages"), "text_sha", F.date_format("archived_at", "yyyy-MM-dd").alias("archived_at"))
    none = F.lit(None).cast("string")
    return kept.union(made.quarantine().select("session", F.col("error").alias("state"), F.lit(0).cast("long").alias("messages"), none.alias("text_sha"), none.alias("archived_at")).distinct())


@query
def import_counts(spark, sf):
    return access.outcome_counts(vault_import_status(spark, sf))


def _foldered(spark, sf) -> DataFrame:
    n = F.substring("session", 1, 8).cast("int")
    return _archive(spark, sf).select("session", F.concat(F.lit("-home-P"), (n % 7).cast("string")).alias("project_dir"), F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("/home/P"), (n % 7).cast("string"))).alias("cwd"))


@query
def project_sessions(spark, sf):
    return vault.of_project(_foldered(spark, sf), "-P1").select("session", vault.project_path().alias("project_path"))


@query
def project_paths(spark, sf):
    """Pages' places as project folders, nine tenths of which still stand, and the mangled names of all of them."""
    place = F.concat(F.lit("/srv/"), F.regexp_replace(F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1), "/+$", ""), F.when(F.col("page_id") % 4 == 0, "/.cache").otherwise(""))
    at = tables.read(spark, sf, "pages").where("url is not null").select("page_id", F.regexp_replace(place, "/+", "/").alias("path"))
    return folders.unmangled(at.select(folders.mangled("path").alias("project_dir")), at.where("page_id % 10 <> 9").select("path"))


@query
def vault_delete(spark, sf):
    return vault.delete("00000003-aaaa", _archive(spark, sf))[0].select("session", "message_count")


@query
def vault_stats(spark, sf):
    return vault.stats(_archive(spark, sf), "m0").select("sessions", "messages", "size_bytes", "other_machines", F.date_format("first_start", "yyyy-MM-dd HH:mm:ss").alias("first_start"), F.date_format("last_end", "yyyy-MM-dd HH:mm:ss").alias("last_end"))


@query
def vault_projects(spark, sf):
    return vault.per_project(_archive(spark, sf))


@query
def vault_list(spark, sf):
    before = vault.date_flag("2024-01-02", True)
    return vault.listing(_archive(spark, sf), "/P1", F.lit("2024-01-01").cast("timestamp"), before).select("session", "project_path", "message_count")


@query
def vault_search(spark, sf):
    rows = _archive_rows(spark, sf)
    archive = rows.select("session").distinct().withColumns({"end_time": F.lit(None).cast("timestamp"), "project_path": F.lit("")})
    return vault.search(rows, archive, "the of", stemmed=False).select("session", F.col("turn_index").cast("int").alias("turn_index"), "role", r6("score").alias("score"), "snippet")


RAW_QUERIES = (
    (1, "NEAR(the of, 2)"), (2, "thi* NOT of"), (3, "content_text : (und OR die) AND der"), (4, '^the OR "of the"'), (5, '"of the" + th* NOT {content_text} : and'), (6, "role: the OR de la"),
    (7, 'NEAR("of the" and en*, 4) AND the'),
)


@query
def vault_raw_search(spark, sf):
    rows = _archive_rows(spark, sf)
    stored = index.Stored(spark, store.once(spark, "messages", sf, lambda at: vault.write_messages(rows, at)))
    return vault.raw_search(stored, list(RAW_QUERIES)).select("query_id", "session", "line_no", r6("score").alias("score"))


@query
def uuid_prefix_lookup(spark, sf):
    return vault.lookup(_archive(spark, sf), "00000001").select("session", "ambiguous")


@query
def composite_hash(spark, sf):
    c = tables.read(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").alias("session"), F.format_string("f%03d", F.col("turn")).alias("relative_path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return vault.composite_hash(rows).select("session", "content_hash", F.col("size_bytes").cast("long").alias("size_bytes"))


@query
def vault_render(spark, sf):
    return vault.render(_archive_rows(spark, sf), markdown=True)


@query
def asof_message(spark, sf):
    """The last message at or before lines 0, 2 and 9 of each session."""
    c = tables.read(spark, sf, "conversations")
    rows = c.where(F.col("turn") % 2 == 1).select(F.col("conv_id").alias("session"), F.col("turn").alias("line_no"), F.lit(0).alias("message_index"))
    wanted = c.select(F.col("conv_id").alias("session")).distinct().select("session", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 2, 9)])).alias("line"))
    return vault.row_for_line(rows, wanted).select("session", "line", F.col("message").cast("int").alias("message"))


@query
def line_for_row(spark, sf):
    """The line at display rows 0, 4 and 10 of each session, whose messages begin at every third row."""
    c = tables.read(spark, sf, "conversations")
    rows = c.where(F.col("turn") % 2 == 1).select(F.col("conv_id").alias("session"), F.col("turn").alias("line_no"), (F.col("turn") * 3).alias("row"))
    wanted = c.select(F.col("conv_id").alias("session")).distinct().select("session", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 4, 10)])).alias("row"))
    return vault.line_for_row(rows, wanted)


@query
def viewer_messages(spark, sf):
    """Assistants launch a subagent in each message; sessions of even numbers have as many archived ones."""
    c = tables.read(spark, sf, "conversations").where("role <> 'system'")
    none, uuid = F.lit(None).cast("string"), F.concat_ws("-", "conv_id", "turn")
    block = lambda kind, text, name, task: F.struct(F.lit(kind).alias("type"), text.alias("text"), name.alias("name"), F.struct(task.alias("description")).alias("input"))
    content = F.when(F.col("role") == "assistant", F.array(block("text", F.col("text"), none, none), block("tool_use", none, F.lit("Task"), F.concat(F.lit("task "), "turn")), block("tool_use", none, F.lit("Grep"), none))).otherwise(F.array(block("text", F.col("text"), none, none)))
    line = F.to_json(F.struct(F.col("role").alias("type"), uuid.alias("uuid"), F.struct(uuid.alias("id"), F.col("role").alias("role"), content.alias("content")).alias("message")))
    lines = c.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("line_no"), line.alias("line"))
    agents = c.where("role = 'assistant' and (conv_id % 2 = 0 or turn < 2)").select(F.col("conv_id").cast("string").alias("session"), F.format_string("a%03d", "turn").alias("agent_id"))
    shown = vault.viewer(sessions.parse_lines(lines), agents)
    return shown.select("session", F.col("no").cast("int").alias("no"), F.col("line_no").cast("int").alias("line_no"), "role", sha("body").alias("body_sha"), "agent_id", "openable")


@query
def subagent_logs(spark, sf):
    """Conversations as logs of subagents, half of them with a meta file."""
    of = tables.log_lines(spark, sf).select(F.concat(F.lit("s"), (F.col("session").cast("int") % 50).cast("string")).alias("session"), F.concat(F.lit("agent-"), "session").alias("agent_id"), "line_no", "line")
    n = F.substring("agent_id", 7, 9).cast("int")
    metas = of.select("session", "agent_id").distinct().withColumn("meta", F.when(n % 2 == 0, F.concat(F.lit('{"agentType":"type'), (n % 3).cast("string"), F.lit('","description":"d"}'))).otherwise("no json"))
    return sessions.subagent_pairs(of, metas).select("session", "agent_id", F.col("pair_no").cast("int").alias("pair_no"), sha("human").alias("human_sha"), "agent_type", "agent_description")


@query
def session_labels(spark, sf):
    return tables.starts(spark, sf).select(sessions.label(F.col("session"), F.col("start_time")).alias("label"))


# -- access, statistics, policy -------------------------------------------------------------------------------------------------


def _calls(spark, sf) -> DataFrame:
    return tables.read(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("at"), "event_id", "event_type")


@query
def search_throttle(spark, sf):
    start = F.lit("1970-01-01").cast("timestamp")
    counted = access.throttle(_calls(spark, sf), start, 36_000)
    return counted.groupBy("client", "count", "limit").agg(F.count("*").alias("n"))


def _streamed(spark, sf, name: str, made) -> DataFrame:
    """What a stream over a table's files has written when it has seen them all: ``made`` goes from rows to rows."""
    at, provider = store.path(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    files = f"{sf}/{name}.parquet*"
    rows = made(spark.readStream.schema(spark.read.parquet(files).schema).parquet(files))
    before = spark.conf.get(provider)
    spark.conf.set(provider, state.PROVIDER)
    try:
        rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


@query
def throttle_stream(spark, sf):
    """As search_throttle, of a stream that keeps each client's window."""
    calls = lambda df: state.throttle(df.select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("at")), 36_000)
    return _streamed(spark, sf, "events", calls).groupBy("client", "count", "limit").agg(F.count("*").alias("n"))


@query
def expiry_stream(spark, sf):
    """Sources whose time has ended by the latest index time, from timers of a stream."""
    d = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("durable", "ephemeral", "session"))), (d % 3 + 1).cast("int"))
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + (d % 90) * 86_400_000_000)
    life = lambda df: state.expiries(df.select(F.concat(F.lit("doc:"), d.cast("string")).alias("label"), kind.alias("kind"), at.alias("indexed_at")))
    return _streamed(spark, sf, "documents", life).select("label", "kind", F.date_format("expired_at", "yyyy-MM-dd HH:mm:ss").alias("expired_at"))


@query
def debounce_latest(spark, sf):
    kept = access.debounce(_calls(spark, sf).dropDuplicates(["client", "at"]), "client", "at", 600_000)
    return kept.groupBy("client").agg(F.count("*").alias("n"))


@query
def guidance_once(spark, sf):
    return access.first_of(_calls(spark, sf), ["client", "event_type"], ["at", "event_id"]).select("client", "event_type", "event_id")


@query
def tool_stats(spark, sf):
    calls = tables.read(spark, sf, "events").select(F.col("event_type").alias("tool"), (F.octet_length("props") * 100).cast("long").alias("raw_bytes"), (F.octet_length("props") * 7).cast("long").alias("shown_bytes"))
    return access.tool_stats(calls).select(F.coalesce("tool", F.lit("(all)")).alias("tool"), "calls", "raw_bytes", "shown_bytes", "tokens", r6("ratio").alias("ratio"), r6("reduction").alias("reduction"))


@query
def sweep_status(spark, sf):
    c = tables.starts(spark, sf)
    n = F.col("session").cast("long")
    found = c.select("session", F.col("start_time").alias("mtime"), F.when(n % 3 == 0, F.timestamp_micros(F.unix_micros("start_time") + 7_200_000_000)).alias("sub_mtime"))
    known = c.where(n % 4 > 0).select(F.concat(F.lit("session:x:"), "session").alias("label"), F.timestamp_micros(F.unix_micros("start_time") + F.when(n % 4 == 1, -1).otherwise(3_600_000_000)).alias("indexed_at"))
    return access.sweep_status(found, known).groupBy("status").agg(F.count("*").alias("n"))


@query
def git_url_parse(spark, sf):
    n = F.col("page_id")
    forms = ["https://github.com/o%d/r/issues/%d", "https://github.com/o%d/r/pull/%d", "https://gitlab.example.com/g%d/p/-/merge_requests/%d", "https://codeberg.org/a%d/b/pulls/%d", "https://github.com/o%d/r%d", "https://bitbucket.org/w%d/r/pull-requests/%d"]
    url = F.element_at(F.array(*[F.format_string(f, n % 10, n) for f in forms]), (n % len(forms) + 1).cast("int"))
    info = tables.read(spark, sf, "pages").select("page_id", policy.platform_url(url).alias("i"))
    return info.where("i is not null").select("page_id", "i.host", "i.owner", "i.repo", "i.number", "i.kind", policy.cli_hint(F.col("i")).alias("hint"))


@query
def private_host(spark, sf):
    n = F.col("c_custkey")
    ip = F.concat_ws(".", F.element_at(F.array(*[F.lit(x) for x in (10, 127, 172, 192, 169, 8, 224)]), (n % 7 + 1).cast("int")), F.when(n % 3 == 0, 168).when(n % 3 == 1, 254).otherwise(n % 40), (n % 250).cast("int"), F.lit(1))
    return tables.read(spark, sf, "customer").select("c_custkey", policy.private_host(ip).alias("private"))


@query
def binary_detect(spark, sf):
    n = F.col("page_id")
    media = F.element_at(F.array(*map(F.lit, ("text/html; charset=utf-8", "image/png", "application/json", "", "APPLICATION/PDF"))), (n % 5 + 1).cast("int"))
    body = F.when(n % 2 == 0, F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("00")))).otherwise(F.concat(F.unhex(F.lit("4100")), F.encode("html", "UTF-8")))
    return tables.read(spark, sf, "pages").select("page_id", policy.is_binary(media, body).alias("is_binary"))


POLICIES = [{"deny": ["Bash(rm:*)", "Bash(sudo *)"], "ask": ["Bash(git push:*)"], "allow": ["Bash(git:*)", "Bash(ls)"]}]


@query
def command_policy(spark, sf):
    n = F.col("event_id")
    forms = ("git status", "git push origin", "ls", "ls && rm -rf /", 'echo "a; rm b"', "cat x | sudo tee y")
    command = F.element_at(F.array(*map(F.lit, forms)), (n % len(forms) + 1).cast("int"))
    decided = tables.read(spark, sf, "events").select(command.alias("command"), policy.command_decision(command, POLICIES).alias("d"))
    return decided.groupBy("command", "d.decision", "d.pattern").agg(F.count("*").alias("n"))


@query
def path_policy(spark, sf):
    path = F.concat(F.lit("src/a"), (F.col("event_id") % 7).cast("string"), F.when(F.col("event_id") % 2 == 0, "/.env").otherwise("\\x\\key.pem"))
    return tables.read(spark, sf, "events").select("event_id", policy.path_denied(path, ["**/.env", "src/a3/**"]).alias("denied_by"))


@query
def web_fetches(spark, sf):
    forms = ("curl https://x.org", "curl -o f https://x.org", "ls; wget x.org/a", "wget x.org > f", "echo curly", "python -c requests.get(1)")
    command = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % len(forms) + 1).cast("int"))
    return tables.read(spark, sf, "events").select(command.alias("command"), policy.fetches_web(command).alias("fetches")).groupBy("command", "fetches").agg(F.count("*").alias("n"))


@query
def coerce_commands(spark, sf):
    n = F.col("event_id").cast("string")
    number = F.col("event_id") % 5
    form = F.when(number == 0, F.concat(F.lit('["ls '), n, F.lit('", 3, {"command":"pwd"}]'))).when(number == 1, F.concat(F.lit('[{"label":"a","command":"c'), n, F.lit('"},{"label":"b"},{"label":"","command":"d"}]')))
    form = form.when(number == 2, F.to_json(F.struct(F.concat(F.lit('["x'), n, F.lit('"]')).alias("v")))).when(number == 3, F.lit('"plain"')).otherwise(F.lit("7"))
    whole = F.try_parse_json(form)
    value = F.when(number == 2, F.try_variant_get(whole, "$.v", "variant")).otherwise(whole)
    got = tables.read(spark, sf, "events").select("event_id", coerce.commands(value).alias("c"), coerce.strings(value).alias("s"))
    return got.select("event_id", F.array_join(F.transform("c", lambda x: F.concat(x["label"], F.lit("="), x["command"])), ";").alias("commands"), F.array_join("s", ";").alias("strings"))


@query
def shell_extract(spark, sf):
    code = F.format_string("import os\nos.system('rm %d')\nsubprocess.run([\"ls\", '-l'])\nsubprocess.call(\"x %d\")", "event_id", "event_id")
    got = tables.read(spark, sf, "events").select("event_id", policy.shell_commands(code, "python").alias("c"))
    return got.select("event_id", F.array_join("c", "|").alias("commands"))


# -- evaluation -----------------------------------------------------------------------------------------------------------------


def _cases(spark, sf) -> DataFrame:
    """Each benchmark item is a needle; its first eight words are the query, and every fifth case is negative."""
    b = tables.read(spark, sf, "benchmark")
    words = F.slice(F.split(F.trim("text"), r"\s+"), 1, 8)
    return b.select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"), F.when(F.col("item_id") % 5 == 4, F.array().cast("array<string>")).otherwise(F.array("text")).alias("needles"), F.concat(F.lit("t"), (F.col("item_id") % 3).cast("string")).alias("content_type"))


def _found(spark, sf) -> DataFrame:
    """Documents that hold an item, and two others of each item, in the order of ids."""
    docs = tables.read(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    items = tables.read(spark, sf, "benchmark")
    held = evaluate.holders(docs, items.select(F.col("item_id").alias("query_id"), "text"))
    extra = items.select(F.col("item_id").alias("query_id"), F.explode(F.array(F.col("item_id") * 2, F.col("item_id") * 2 + 1)).alias("doc_id")).join(docs, "doc_id").select("query_id", "doc_id", "content")
    both = held.union(extra).dropDuplicates(["query_id", "doc_id"])
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("doc_id")))


@query
def needle_containment(spark, sf):
    rated = evaluate.relevance(_found(spark, sf), _cases(spark, sf))
    return rated.select("query_id", F.col("rank").cast("int").alias("rank"), "relevant")


NAMES = ("recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "ndcg_at_10", "mrr", "context_recall")


@query
def niah_metrics(spark, sf):
    per = evaluate.case_metrics(_found(spark, sf), _cases(spark, sf))
    return per.select("query_id", *[r6(c).alias(c) for c in NAMES], "false_positive")


@query
def niah_summary(spark, sf):
    means = evaluate.summary(evaluate.case_metrics(_found(spark, sf), _cases(spark, sf)))
    return means.select(F.coalesce("content_type", F.lit("(all)")).alias("content_type"), r6("recall_at_10").alias("recall_at_10"), r6("mrr").alias("mrr"), r6("avg_context_recall").alias("avg_context_recall"), r6("avg_context_recall_all").alias("avg_context_recall_all"), "case_count", "negative_case_count")


@query
def niah_search(spark, sf):
    """The search itself on all benchmark items, whatever the kind of their sources: an item's first eight words are the query.

    An item that some document holds is a needle, as a whole, as its document was indexed (redacted and trimmed); the others
    are negative cases, and whatever is found for them is a false positive. Results are shown as snippets: what those save of
    the chunks is the compression, and the recall of contexts is that of whole needles in them."""
    cases = _cases(spark, sf).select("query_id", "query", "content_type")
    whole = tables.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.trim(text.redact("text")).alias("needle"))
    holding = whole.join(_held(spark, sf), "query_id")
    none = F.array().cast("array<string>")
    asked = store.kept(cases.join(holding, "query_id", "left").withColumn("needles", F.when(F.col("needle").isNotNull(), F.array("needle")).otherwise(none)).drop("needle"), "cases")
    results = store.kept(search.search(_corpus(spark, sf), asked.select("query_id", "query"), search.Options(limit=10, kinds=search.KINDS)), "results")
    per = evaluate.case_metrics(results.select("query_id", "rank", "content"), asked)
    shown = store.kept(results.join(asked.select("query_id", "query"), "query_id").withColumn("snippet", snippets.snippet("content", "query")), "shown")
    sizes = shown.groupBy("query_id").agg(F.count("*").alias("returned"), F.sum(F.octet_length("snippet")).alias("s"), F.sum(F.octet_length("content")).alias("w"))
    in_snippets = evaluate.case_metrics(shown.select("query_id", "rank", F.col("snippet").alias("content")), asked)
    reduced = evaluate.context_reduction(in_snippets.join(sizes, "query_id", "left").withColumn("compression", F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.col("s") / F.col("w")), F.lit(1.0))).drop("s", "w"))
    layers = evaluate.layer_checks(results.select("query_id", "rank", "content", "match_layer"), asked.withColumns({"expected_layer": F.lit("rrf(porter+trigram)"), "ceiling": F.lit(3)}))
    type_ = F.coalesce("content_type", F.lit("(all)")).alias("content_type")
    means = evaluate.summary(per).select(type_, *[r6(c).alias(c) for c in NAMES[:-1]], r6("avg_context_recall").alias("avg_context_recall"), "case_count", "negative_case_count", "negative_false_positive_count")
    saved = evaluate.reduction_summary(reduced).select(type_, *[r6(c).alias(c) for c in ("avg_compression_ratio", "perfect_recall_rate", "avg_effective_compression")])
    checked = evaluate.layer_summary(layers).select(type_, r6("match_layer_accuracy").alias("match_layer_accuracy"), r6("rank_ceiling_pass_rate").alias("rank_ceiling_pass_rate"))
    return means.join(saved, "content_type", "left").join(checked, "content_type", "left")


def _held(spark, sf) -> DataFrame:
    """Items that some document holds."""
    docs = tables.read(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    items = tables.read(spark, sf, "benchmark")
    return evaluate.holders(docs, items.select(F.col("item_id").alias("query_id"), "text")).select("query_id").distinct()


@query
def layer_checks(spark, sf):
    """Results of odd ranks are said to come from the trigram layer, which all cases expect; ceilings are 0 to 2."""
    found = _found(spark, sf).withColumn("match_layer", F.when(F.col("rank") % 2 == 1, "trigram").otherwise("porter"))
    cases = _cases(spark, sf).withColumns({"expected_layer": F.when(F.col("query_id") % 4 == 0, "porter").otherwise("trigram"), "ceiling": (F.col("query_id") % 3).cast("int")})
    return evaluate.layer_checks(found, cases).select("query_id", "layer_match", F.col("first").cast("int").alias("first"), "ceiling_pass", "failure")


def _reduced(spark, sf) -> DataFrame:
    per = evaluate.case_metrics(_found(spark, sf), _cases(spark, sf))
    returned = F.when(F.col("query_id") % 10 == 9, 0).otherwise(3)
    return evaluate.context_reduction(per.select("query_id", "content_type", "needles", "context_recall", returned.alias("returned"), ((F.col("query_id") % 8) / 8).alias("compression")))


@query
def context_reduction(spark, sf):
    return _reduced(spark, sf).select("query_id", *[r6(c).alias(c) for c in evaluate.REDUCTION])


@query
def reduction_summary(spark, sf):
    means = evaluate.reduction_summary(_reduced(spark, sf))
    return means.select(F.coalesce("content_type", F.lit("(all)")).alias("content_type"), *[r6(c).alias(c) for c in evaluate.REDUCTION.values()])


@query
def report_compare(spark, sf):
    """The metrics of even items against those of odd ones."""
    per = evaluate.case_metrics(_found(spark, sf), _cases(spark, sf))
    long = per.select("query_id", "content_type", F.explode(F.create_map(*[x for c in ("recall_at_10", "mrr") for x in (F.lit(c), F.col(c))], F.lit("avg_context_recall"), F.col("context_recall"))).alias("metric", "v"))
    side = lambda r: long.where(F.col("query_id") % 2 == r).groupBy("content_type", "metric").agg(F.avg("v").alias("value"))
    return evaluate.compare(side(0), side(1)).select("content_type", "metric", r6("delta").alias("delta"), "regression")


@query
def failure_diff(spark, sf):
    o = tables.read(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("type"), (F.col("o_orderkey") % 2).alias("side"))
    return evaluate.failure_diff(o.where("side = 0"), o.where("side = 1")).select("case_id", "type", "change")


@query
def output_budget(spark, sf):
    docs = tables.read(spark, sf, "documents").select((F.col("doc_id") % 20).alias("request"), F.col("doc_id").alias("query_no"), "text")
    return snippets.within_budget(docs).select("request", "query_no")


@query
def snippet_text(spark, sf):
    docs = tables.read(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return docs.select("doc_id", snippets.snippet("text", F.lit("license apache"), 400).alias("snippet"))


@query
def edit_distance(spark, sf):
    near = tables.read(spark, sf, "customer").select("c_custkey", text.byte_levenshtein(F.lower("c_name"), F.lit("cüstomer#00000042")).alias("d"))
    return near.select("c_custkey", F.col("d").cast("int").alias("d"))


@query
def intent_summary(spark, sf):
    chunks = tables.kept_chunks(spark, sf, "source_id", "chunk_no", "title", "content")
    found = chunks.where(F.contains(F.lower("content"), F.lit("license"))).withColumn("rank", F.row_number().over(W.partitionBy("source_id").orderBy("chunk_no"))).where("rank <= 3")
    facts = tables.documents(spark, sf).select("source_id", F.concat(F.lit("doc:"), F.col("source_id").cast("string")).alias("label"), F.size(F.split("text", "\n")).alias("lines"), F.octet_length("text").alias("bytes"))
    counts = chunks.groupBy("source_id").agg(F.count("*").alias("chunks"))
    return snippets.intent_summary(found, index.distinctive_terms(chunks, 5), facts.join(counts, "source_id"))


@query
def line_scan(spark, sf):
    """Pages as files of lines: physical numbers, no empty lines."""
    p = tables.read(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n", "\r\n\n").alias("content"))
    return files.whole_lines(p, most=5000).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("line_no").cast("int").alias("last_line"))


def queries() -> dict[str, Query]:
    return dict(ALL)
