"""Content lifecycle: hashes and size guards, upserts by label, retention tiers, expiry, eviction and statistics.

Time enters as the parameter ``as_of``. Operators that change a table return the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import store
from ..functions.text import col, one_decimal

#: Decay per day, weight of recent access, tier borders, salience of code, mixed and prose sources.
DECAY, ACCESS, HOT, WARM, COLD = 0.045, 0.3, 0.7, 0.4, 0.15
CODE, MIXED, PROSE, BONUS, BONUS_MOST = 0.7, 0.6, 0.5, 0.02, 0.2
#: Hours that ephemeral and session sources live, and bytes a source may have.
EPHEMERAL_HOURS, SESSION_HOURS, FETCH_HOURS, MAX_SOURCE_BYTES = 24, 60 * 24, 24, 2 * 1024 * 1024
KINDS = ("ephemeral", "durable", "session")


def content_hash(x: Column | str) -> Column:
    return F.sha2(col(x).cast("binary"), 256)


def size_guard(docs: DataFrame, text: str = "text", most: int = MAX_SOURCE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with bytes): raw bytes count, before redaction."""
    sized = docs.withColumn("bytes", F.octet_length(F.coalesce(text, F.lit(""))))
    return sized.where(F.col("bytes") <= most).drop("bytes"), sized.where(F.col("bytes") > most)


def days_since(then: Column | str, as_of: Column) -> Column:
    """Days, 0 for the future."""
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(col(then).cast("timestamp"))
    return F.greatest(seconds / 86_400e6, F.lit(0.0))


def retention_score(as_of: Column) -> Column:
    """Over chunk_count, code_chunk_count, access_count, indexed_at, last_accessed_at."""
    code, n = F.col("code_chunk_count"), F.col("access_count")
    salience = F.when((code > 0) & (code == F.col("chunk_count")), CODE).when(code > 0, MIXED).otherwise(PROSE)
    salience += F.least(F.lit(BONUS_MOST), n * BONUS)
    recent = F.when((n > 0) & F.col("last_accessed_at").isNotNull(), 1.0 / (1.0 + days_since("last_accessed_at", as_of))).otherwise(0.0)
    return salience * F.exp(-DECAY * days_since("indexed_at", as_of)) + ACCESS * recent


def tier(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= HOT, "hot").when(s >= WARM, "warm").when(s >= COLD, "cold").otherwise("evictable")


def _hours(n: float, otherwise: float) -> float:
    return n if n > 0 else otherwise


def classify(sources: DataFrame, as_of: Column, ephemeral_hours: float = EPHEMERAL_HOURS, session_hours: float = SESSION_HOURS) -> DataFrame:
    """Adds tier and retention_score (0 for kinds that live by age)."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("indexed_at").cast("timestamp"))
    hours = F.when(F.col("kind") == "ephemeral", _hours(ephemeral_hours, EPHEMERAL_HOURS)).otherwise(_hours(session_hours, SESSION_HOURS))
    aged = F.col("kind").isin("ephemeral", "session")
    score = retention_score(as_of)
    by_age = F.when(age > hours * 3600e6, "stale").otherwise("fresh")
    return sources.withColumn("retention_score", F.when(aged, 0.0).otherwise(score)).withColumn("tier", F.when(aged, by_age).otherwise(tier("retention_score")))


def source_sizes(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds chunk rows and characters of content; chunks are summed before the join."""
    sums = chunks.groupBy("source_id").agg(F.count("*").alias("chunk_rows"), F.sum(F.length("content")).alias("content_bytes"))
    return sources.join(sums, "source_id", "left").fillna(0, ["chunk_rows", "content_bytes"])


def judged(sized: DataFrame, as_of: Column, most: int = MAX_SOURCE_BYTES, ephemeral_hours: float = EPHEMERAL_HOURS, session_hours: float = SESSION_HOURS) -> DataFrame:
    """source_sizes with tier, retention_score and eviction_reason, null for sources that stay; the first that fits: oversized,
    retention, then the kind's age."""
    rated = classify(sized, as_of, ephemeral_hours, session_hours)
    forgotten = (F.col("kind") == "durable") & (F.col("retention_score") < COLD) & (F.col("access_count") == 0)
    reason = F.when(F.col("content_bytes") > most, "oversized").when(forgotten, "retention").when(F.col("tier") == "stale", F.concat(F.lit("ttl_"), "kind"))
    return rated.withColumn("eviction_reason", reason)


def eviction_candidates(sources: DataFrame, chunks: DataFrame, as_of: Column, most: int = MAX_SOURCE_BYTES, ephemeral_hours: float = EPHEMERAL_HOURS, session_hours: float = SESSION_HOURS) -> DataFrame:
    """Sources to evict with eviction_reason."""
    return judged(source_sizes(sources, chunks), as_of, most, ephemeral_hours, session_hours).where("eviction_reason is not null")


def by_label(sources: DataFrame, pattern: str) -> DataFrame:
    """Sources to evict by label: exact, or with % as wildcards."""
    hit = F.col("label").ilike(pattern) if "%" in pattern else F.col("label") == pattern
    return sources.where(hit).withColumn("eviction_reason", F.lit("label"))


def evict(sources: DataFrame, chunks: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and chunks without the candidates; the vocabulary is never shrunk."""
    gone = candidates.select("source_id").distinct()
    return sources.join(gone, "source_id", "left_anti"), chunks.join(gone, "source_id", "left_anti")


def upsert_plan(incoming: DataFrame, sources: DataFrame) -> DataFrame:
    """Of incoming label, kind, content_hash, seq: the last of each label, with its action.

    insert: new label. skip: same hash and kind. rekind: same hash, other kind. replace: other hash (a new id, counters reset).
    """
    wrong = incoming.where(~F.col("kind").isin(*KINDS))
    last = incoming.join(wrong.select("label", "seq"), ["label", "seq"], "left_anti").groupBy("label").agg(F.max_by(F.struct("kind", "content_hash", "seq"), "seq").alias("x")).select("label", "x.*")
    known = sources.select("label", F.col("source_id").alias("old_id"), F.col("kind").alias("old_kind"), F.col("content_hash").alias("old_hash"))
    joined = last.join(known, "label", "left")
    action = F.when(F.col("old_id").isNull(), "insert").when(F.col("old_hash") != F.col("content_hash"), "replace").when(F.col("old_kind") != F.col("kind"), "rekind").otherwise("skip")
    return joined.withColumn("action", action)


def numbered(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """df with consecutive numbers in the order of a column. Ranges are numbered apart, after their sizes (a number for each
    partition) are known: no task sees all rows."""
    ranged = store.kept(df.repartitionByRange(order).withColumn("range_", F.spark_partition_id()), "ranged")
    sizes = dict(tuple(r) for r in ranged.groupBy("range_").agg(F.count("*")).collect())
    before, at = {}, start
    for k in sorted(sizes):
        before[k], at = at, at + sizes[k]
    first = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("range_")] if before else F.lit(start)
    nth = F.row_number().over(W.partitionBy("range_").orderBy(order)) - 1
    return ranged.withColumn(name, (first + nth).cast("long")).drop("range_")


def apply_upsert(sources: DataFrame, plan: DataFrame, as_of: Column) -> DataFrame:
    """The new sources. Skips and rekinds touch last_accessed_at; inserts and replacements get ids after the largest."""
    top = sources.agg(F.coalesce(F.max("source_id"), F.lit(-1))).first()[0]
    at = as_of.cast("timestamp")
    kept = sources.join(plan.select("label", "action", F.col("kind").alias("new_kind")), "label", "left").where("action is null or action <> 'replace'")
    touched = F.col("action").isin("skip", "rekind")
    kept = kept.withColumn("kind", F.when(F.col("action") == "rekind", F.col("new_kind")).otherwise(F.col("kind"))).withColumn("last_accessed_at", F.when(touched, at).otherwise(F.col("last_accessed_at")))
    fresh = numbered(plan.where(F.col("action").isin("insert", "replace")), "seq", "source_id", top + 1)
    made = fresh.select("source_id", "label", "kind", "content_hash", at.alias("indexed_at"), at.alias("last_accessed_at"), F.lit(0).alias("access_count"))
    return kept.select(*sources.columns).unionByName(made, allowMissingColumns=True)


def fetch_cache(requests: DataFrame, sources: DataFrame, as_of: Column, hours: float = FETCH_HOURS) -> DataFrame:
    """Adds hit: same label and kind, indexed within the last ``hours`` (a repeated index of the same text doesn't renew it)."""
    known = sources.select("label", F.col("kind").alias("have_kind"), F.col("indexed_at").alias("have_at"))
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("have_at").cast("timestamp"))
    joined = requests.join(known, "label", "left")
    return joined.withColumn("hit", F.coalesce((F.col("have_kind") == F.col("kind")) & (age < hours * 3600e6), F.lit(False))).drop("have_kind", "have_at")


def retag(sources: DataFrame) -> DataFrame:
    """Labels of command output are ephemeral."""
    return sources.withColumn("kind", F.when(F.col("label").rlike("^(execute|file|batch):"), "ephemeral").otherwise(F.col("kind")))


def stats(sources: DataFrame, chunks: DataFrame, as_of: Column, vocabulary: DataFrame | None = None) -> DataFrame:
    """sources, chunks, words of the vocabulary (if given) and sources by kind and tier, in long form: metric, value."""
    rated = classify(sources, as_of)
    long = rated.groupBy("kind", "tier").agg(F.count("*").alias("value")).select(F.concat("kind", F.lit("."), "tier").alias("metric"), "value")
    count = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    both = long.union(count(rated, "sources")).union(count(chunks, "chunks"))
    return both if vocabulary is None else both.union(count(vocabulary, "vocabulary"))


def kind_sizes(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    return source_sizes(sources, chunks).groupBy("kind").agg(F.count_distinct("source_id").alias("sources"), F.sum("chunk_rows").alias("chunks"), F.sum("content_bytes").alias("content_bytes"))


def top_sources(sources: DataFrame, chunks: DataFrame, n: int = 15) -> DataFrame:
    return source_sizes(sources, chunks).orderBy(F.desc("content_bytes"), "label").limit(n)


def oversized(sources: DataFrame, chunks: DataFrame, most: int = MAX_SOURCE_BYTES) -> DataFrame:
    """Largest first."""
    return source_sizes(sources, chunks).where(F.col("content_bytes") > most).orderBy(F.desc("content_bytes"), "label")


def newest(sources: DataFrame, limit: int = 0) -> DataFrame:
    """Newest first; 0 is no limit."""
    found = sources.orderBy(F.desc("source_id"))
    return found.limit(limit) if limit else found


def chunks_of(sources: DataFrame, chunks: DataFrame, label: str) -> DataFrame:
    """The chunks of one source, in order."""
    one = sources.where(F.col("label") == label).select("source_id")
    return chunks.join(F.broadcast(one), "source_id").orderBy("chunk_no")


def section_inventory(chunks: DataFrame) -> DataFrame:
    """source_id, inventory: a line of title and size for each section, in order."""
    line = F.concat(F.lit("- "), "title", F.lit(" ("), one_decimal(F.octet_length("content") / 1024), F.lit("KB)"))
    listed = F.array_sort(F.collect_list(F.struct("chunk_no", line.alias("line"))))
    return chunks.groupBy("source_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("inventory"))


def smart_truncate(x: Column | str, most: int = 100_000, share: float = 0.6) -> Column:
    """Whole lines from both ends within ``most`` bytes, ``share`` of them from the front, with a note of what was left out."""
    x = col(x)
    lines = F.split(x, "\n")

    def fitting(ls: Column, room: int) -> Column:
        """How many lines from the start fit into ``room`` bytes with their line ends; the first always does."""
        sizes = F.transform(ls, lambda x: F.octet_length(x) + 1)
        start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("n"), F.lit(True).alias("on"))

        def step(s: Column, size: Column) -> Column:
            on = s["on"] & ((s["size"] + size <= room) | (s["n"] == 0))
            return F.struct((s["size"] + F.when(on, size).otherwise(0)).alias("size"), (s["n"] + on.cast("int")).alias("n"), on.alias("on"))

        return F.aggregate(sizes, start, step)

    room = int(most * share)
    front = fitting(lines, room)
    back = fitting(F.reverse(F.slice(lines, front["n"] + 1, F.greatest(F.lit(0), F.size(lines) - front["n"]))), most - room)
    note = F.format_string("\n\n... [%d lines / %sKB truncated — showing first %d + last %d lines] ...\n\n", F.size(lines) - front["n"] - back["n"], one_decimal((F.octet_length(x) - front["size"] - back["size"]) / 1024.0), front["n"], back["n"])
    tail = F.slice(lines, F.size(lines) - back["n"] + 1, back["n"])
    cut = F.concat(F.array_join(F.slice(lines, F.lit(1), front["n"]), "\n"), note, F.array_join(tail, "\n"))
    return F.when(F.octet_length(x) <= most, x).otherwise(cut)


def exit_class(language: Column, code: Column, stdout: Column) -> Column:
    """A shell's exit 1 with output is a soft failure."""
    soft = (language == "shell") & (code == 1) & (F.length(F.trim(stdout)) > 0)
    return F.when(code == 0, "ok").when(soft, "soft_fail").otherwise("fail")
