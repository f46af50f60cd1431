"""The session archive: messages of raw logs, idempotent imports, search and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import head, head_tail, redact, trim
from . import index, rawquery
from .sessions import blocks, clean_text, merged_blocks, text_of

#: Characters of a tool's result, of a title, of an agent's prompt; words of a snippet; characters of a launch.
RESULT_CHARS, TITLE_CHARS, PROMPT_CHARS, SNIPPET, LAUNCH_CHARS = 16_384, 120, 200, 16, 100
ATTACHED = ("text", "filename", "fileName", "name", "title", "source", "path")


def _plain(b: Column) -> Column:
    """The text of a tool's result: a string, or its text blocks."""
    many = F.try_variant_get(b, "$", "array<variant>")
    parts = F.filter(F.transform(many, lambda x: F.when(text_of(x, "$.type") == "text", trim(F.coalesce(text_of(x, "$.text"), F.lit(""))))), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.when(F.schema_of_variant(b) == "STRING", trim(F.try_variant_get(b, "$", "string"))), F.array_join(parts, "\n"), F.lit(""))


def tool_summary(name: Column, raw: Column) -> Column:
    got = lambda k: F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit(""))
    shown = F.when(name.isin("Read", "Edit", "Write") & (got("file_path") != ""), F.concat(name, F.lit(" "), got("file_path")))
    shown = shown.when((name == "Bash") & (got("command") != ""), F.concat(F.lit("Bash "), got("command")))
    return shown.when(name.isin("Agent", "Task") & (got("prompt") != ""), F.concat(F.lit("Agent "), head(got("prompt"), PROMPT_CHARS))).otherwise(name)


def pr_link(number: Column, repository: Column, url: Column) -> Column:
    n = F.trim(F.coalesce(number, F.lit("")))
    parts = F.array(F.when(~n.isin("", "0"), F.concat(F.lit("PR #"), n)), F.nullif(repository, F.lit("")), F.nullif(url, F.lit("")))
    return F.array_join(parts, " ")


def _attachment(message: Column) -> Column:
    many = F.try_variant_get(message, "$.content", "array<variant>")
    values = lambda b: F.array_distinct(F.filter(F.array(*[trim(F.coalesce(text_of(b, f"$.{k}"), F.lit(""))) for k in ATTACHED]), lambda t: t != ""))
    plain = F.try_variant_get(message, "$.content", "string")
    return F.coalesce(F.array_join(F.flatten(F.transform(many, values)), " "), trim(plain), F.lit(""))


def messages(parsed: DataFrame) -> DataFrame:
    """session, turn_index, message_index, line_no, role, text, ts of parsed log lines.

    A turn begins with the user's own text, unless nothing was there before; results of tools are messages of role tool.
    """
    user = parsed.where("type = 'user' and message is not null")
    texts = F.filter(F.transform(F.filter(blocks(F.col("message")), lambda b: b["type"] == "text"), lambda b: clean_text(F.coalesce(b["text"], F.lit("")))), lambda t: t != "")
    human = user.select("session", "line_no", "ts", F.lit("user").alias("role"), F.lit(-1).alias("no"), F.array_join(texts, "\n").alias("text"))
    results = F.filter(blocks(F.col("message")), lambda b: b["type"] == "tool_result")
    tools = user.select("session", "line_no", "ts", F.posexplode(F.transform(results, lambda b: head_tail(_plain(b["content"]), RESULT_CHARS))).alias("no", "text")).withColumn("role", F.lit("tool"))
    part = lambda b: F.when(b["type"] == "text", trim(F.coalesce(b["text"], F.lit("")))).when(b["type"] == "tool_use", tool_summary(F.coalesce(b["name"], F.lit("")), b["input"]))
    mine = merged_blocks(parsed).select("session", "line_no", "ts", F.lit("assistant").alias("role"), F.lit(0).alias("no"), F.array_join(F.filter(F.transform("blocks", part), lambda t: t.isNotNull() & (t != "")), "\n").alias("text"))
    said = F.when(F.col("type") == "pr-link", pr_link(F.col("prNumber"), F.col("prRepository"), F.col("prUrl"))).when(F.col("type") == "attachment", _attachment(F.col("message"))).otherwise(trim(F.coalesce("content", F.lit(""))))
    system = parsed.where("type in ('pr-link', 'attachment') or type = 'system' and subtype = 'away_summary'").select("session", "line_no", "ts", F.lit("system").alias("role"), F.lit(0).alias("no"), said.alias("text"))
    rows = human.unionByName(tools).unionByName(mine).unionByName(system).withColumn("text", trim("text"))
    rows = rows.withColumn("text", redact("text")).where("text <> ''")
    return number_turns(rows)


def number_turns(rows: DataFrame) -> DataFrame:
    """Of session, line_no, no, role: turn_index and message_index within the turn."""
    order = W.partitionBy("session").orderBy("line_no", "no")
    nth = F.row_number().over(order)
    new = ((F.col("role") == "user") & (F.col("nth") > 1)).cast("int")
    turn = F.sum(new).over(order.rowsBetween(W.unboundedPreceding, 0))
    turned = rows.withColumn("nth", nth).withColumn("turn_index", turn)
    place = F.row_number().over(W.partitionBy("session", "turn_index").orderBy("nth")) - 1
    return turned.withColumn("message_index", place).drop("nth", "no")


def sessions(parsed: DataFrame, rows: DataFrame) -> DataFrame:
    """session, title, cwd, branch, start_time, end_time, message_count."""
    plain = F.when((F.col("type") == "user") & (F.schema_of_variant(F.try_variant_get("message", "$.content", "variant")) == "STRING"), trim(F.try_variant_get("message", "$.content", "string")))
    usable = F.when((plain != "") & ~F.startswith(plain, F.lit("<")), plain)
    first = lambda c, where: F.min_by(c, F.when(where, F.col("line_no")))
    facts = parsed.withColumn("plain", usable).groupBy("session").agg(
        F.max_by("aiTitle", F.when((F.col("type") == "ai-title") & (F.col("aiTitle") != ""), F.col("line_no"))).alias("ai"),
        first("plain", F.col("plain").isNotNull()).alias("fallback"),
        first("cwd", (F.col("type") == "user") & (F.col("cwd") != "")).alias("cwd"), first("gitBranch", (F.col("type") == "user") & (F.col("gitBranch") != "")).alias("branch"),
        first("ts", F.col("ts").isNotNull()).alias("start_time"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("end_time"),
    )
    counts = rows.groupBy("session").agg(F.count_if(F.col("role").isin("user", "assistant")).alias("message_count"))
    title = F.coalesce(redact("ai"), head(redact("fallback"), TITLE_CHARS), F.lit(""))
    return facts.join(counts, "session", "left").select("session", title.alias("title"), "cwd", "branch", "start_time", "end_time", F.coalesce("message_count", F.lit(0)).alias("message_count"))


def composite_hash(files: DataFrame) -> DataFrame:
    """session, content_hash, size_bytes of session, relative_path, content (binary): names and contents with 8-byte lengths, by name."""
    framed = lambda x: F.concat(F.lpad(F.hex(F.octet_length(x).cast("long")), 16, "0"), F.hex(x))
    each = files.select("session", F.col("relative_path").cast("binary").alias("k"), F.col("content").alias("c"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: F.concat(framed(x["k"]), framed(x["c"]))), "")
    return each.groupBy("session").agg(F.sha2(F.unhex(joined), 256).alias("content_hash"), F.sum(F.octet_length("c")).alias("size_bytes"))


def import_plan(incoming: DataFrame, archive: DataFrame, as_of: Column) -> DataFrame:
    """Adds status (new, updated, skipped) and archived_at to incoming session, content_hash, size_bytes; what is archived keeps its time."""
    have = archive.select("session", F.col("content_hash").alias("old_hash"), F.col("size_bytes").alias("old_size"), F.col("archived_at").alias("old_at"))
    joined = incoming.join(have, "session", "left")
    newer = (F.col("content_hash") != F.col("old_hash")) & (F.col("size_bytes") >= F.col("old_size"))
    status = F.when(F.col("old_hash").isNull(), "new").when(newer, "updated").otherwise("skipped")
    return joined.withColumn("status", status).withColumn("archived_at", F.coalesce("old_at", as_of.cast("timestamp"))).drop("old_hash", "old_size", "old_at")


def delete(session: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """All tables without a session."""
    return tuple(t.where(~F.col("session").eqNullSafe(F.lit(session))) for t in tables)


def lookup(archive: DataFrame, prefix: str) -> DataFrame:
    """Sessions whose id starts with 8 characters or more of ``prefix``: none, the one, or the candidates, with ambiguous."""
    if len(prefix) < 8:
        raise ValueError("a prefix has 8 characters or more")
    found = archive.where(F.startswith("session", F.lit(prefix)))
    return found.crossJoin(F.broadcast(found.agg((F.count("*") > 1).alias("ambiguous"))))


def listing(archive: DataFrame, project: str = "", after: Column | None = None, before: Column | None = None, limit: int = 0) -> DataFrame:
    """Newest end first, null ends last; 0 is no limit."""
    found = filtered(archive, project, after, before).orderBy(F.desc_nulls_last("end_time"), "session")
    return found.limit(limit) if limit else found


def filtered(rows: DataFrame, project: str = "", after: Column | None = None, before: Column | None = None) -> DataFrame:
    if project:
        rows = rows.where(F.col("project_path").ilike("%" + project.replace("\\", "\\\\") + "%"))
    rows = rows if after is None else rows.where(F.col("end_time") >= after)
    return rows if before is None else rows.where(F.col("end_time") <= before)


def date_flag(raw: str, end_of_day: bool) -> Column:
    """A day (its end, for an upper bound) or a full timestamp."""
    at = F.try_to_timestamp(F.lit(raw))
    day = len(raw) == 10
    return at + F.expr("INTERVAL '0 23:59:59' DAY TO SECOND") if day and end_of_day else at


def stats(archive: DataFrame, machine: str = "") -> DataFrame:
    return archive.agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
        F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"), F.count_if(F.col("machine_id") != machine).alias("other_machines"),
    )


def per_project(archive: DataFrame) -> DataFrame:
    return archive.groupBy("project_path").agg(F.count("*").alias("sessions"))


def search(rows: DataFrame, archive: DataFrame, query: str, role: str = "", limit: int = 20, stemmed: bool = True, **filters) -> DataFrame:
    """The best messages that hold all words of ``query``: session, turn_index, message_index, role, score, snippet."""
    spark = rows.sparkSession
    keyed = rows.withColumn("chunk_id", F.xxhash64("session", "turn_index", "message_index")).withColumn("title", F.lit("")).withColumnRenamed("text", "content")
    words = [w for w in dict.fromkeys(query.split()) if w]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    scored = index.bm25(index.word_hits(keyed, terms, stemmed), index.word_stats(keyed))
    best = scored.groupBy("chunk_id").agg(F.sum("score").alias("score"), F.count_distinct("term").alias("n")).where(F.col("n") == len(words))
    found = keyed.join(best, "chunk_id").join(filtered(archive, **filters).select("session"), "session", "left_semi")
    found = found.where(F.col("role") == role) if role else found
    return found.orderBy("score", "session", "turn_index", "message_index").limit(limit).select("session", "turn_index", "message_index", "role", "score", snippet(F.col("content"), words).alias("snippet"))


def write_messages(rows: DataFrame, path: str) -> None:
    """An index of messages: session (a number), line_no, text; a message is a chunk of its session by its line."""
    keyed = rows.select(F.col("session").cast("long").alias("source_id"), F.col("line_no").cast("int").alias("chunk_no"), F.lit("").alias("title"), F.col("text").alias("content"), F.lit("prose").alias("content_type"))
    index.write_index(keyed.withColumn("chunk_id", index.chunk_id()), path)


def raw_search(stored: index.Stored, queries: list[tuple[int, str]]) -> DataFrame:
    """query_id, session, line_no, score of messages that meet raw queries; the messages' one column is content_text."""
    found = rawquery.search(stored, queries, ("", "content_text"))
    return found.select("query_id", index.source_of("chunk_id").alias("session"), (F.col("chunk_id") % 2**20).cast("int").alias("line_no"), "score")


def snippet(text: Column, words: list[str], n: int = SNIPPET) -> Column:
    """About ``n`` words around the first hit, hits in [ ]."""
    parts = F.split(text, r"\s+")
    hit = lambda w: F.exists(F.array(*[F.lit(x.lower()) for x in words]), lambda x: F.contains(F.lower(w), x))
    at = F.array_min(F.filter(F.transform(parts, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull()))
    start = F.greatest(F.lit(0), F.coalesce(at, F.lit(0)) - n // 2)
    shown = F.transform(F.slice(parts, start + 1, n), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.array_join(shown, " "), F.when(start + n < F.size(parts), "…").otherwise(""))


def render(rows: DataFrame, markdown: bool = False) -> DataFrame:
    """session, text: all messages in order; in Markdown, tool output stands in a fence longer than any in it."""
    runs = F.transform(F.regexp_extract_all("text", F.lit("`+"), F.lit(0)), F.length)
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    body = F.when(F.col("role") == "tool", F.concat(fence, F.lit("\n"), "text", F.lit("\n"), fence)).otherwise(F.col("text")) if markdown else F.col("text")
    head_ = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n")) if markdown else F.concat(F.lit("["), "role", F.lit("] "))
    each = rows.withColumn("block", F.concat(head_, body))
    order = F.array_sort(F.collect_list(F.struct("turn_index", "message_index", "block")))
    return each.groupBy("session").agg(F.array_join(F.transform(order, lambda x: x["block"]), "\n\n").alias("text"))


def row_for_line(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """session, line, message (0 where none): the last message at or before each wanted line, by one pass in line order."""
    marks = rows.select("session", F.col("line_no").alias("line"), (F.row_number().over(W.partitionBy("session").orderBy("line_no", "message_index")) - 1).alias("message"), F.lit(0).alias("asked"))
    both = marks.unionByName(wanted.select("session", "line", F.lit(None).cast("int").alias("message"), F.lit(1).alias("asked")))
    last = F.last("message", ignorenulls=True).over(W.partitionBy("session").orderBy("line", "asked").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("message", F.coalesce(last, F.lit(0))).where("asked = 1").drop("asked")


def line_for_row(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """session, row, line (0 where none): the line of the last message whose display row (session, line_no, row) is at or
    before each wanted row."""
    marks = rows.select("session", "row", F.col("line_no").cast("long").alias("line"), F.lit(0).alias("asked"))
    both = marks.unionByName(wanted.select("session", "row", F.lit(None).cast("long").alias("line"), F.lit(1).alias("asked")))
    last = F.last("line", ignorenulls=True).over(W.partitionBy("session").orderBy("row", "asked").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("line", F.coalesce(last, F.lit(0).cast("long"))).where("asked = 1").drop("asked")


def of_project(incoming: DataFrame, part: str) -> DataFrame:
    """Sessions whose project folder, as its name is mangled, holds ``part``, in the same case."""
    return incoming.where(F.contains("project_dir", F.lit(part))) if part else incoming


def project_path(cwd: Column | str = "cwd", project_dir: Column | str = "project_dir") -> Column:
    """The working folder that a log names, else the mangled name of the project's folder."""
    c, p = (F.col(x) if isinstance(x, str) else x for x in (cwd, project_dir))
    return F.coalesce(F.nullif(c, F.lit("")), p)


def viewer(parsed: DataFrame, agents: DataFrame) -> DataFrame:
    """A transcript as it is shown: session, no, line_no, role (user, tool, assistant, subagent, system), body, agent_id, openable.

    A launch of a subagent is a marker of its own. Markers are paired with the archived subagents (session, agent_id), in
    order, only where a session has as many of one as of the other; else they can't be opened."""
    user = parsed.where("type = 'user' and message is not null")
    texts = F.filter(F.transform(F.filter(blocks(F.col("message")), lambda b: b["type"] == "text"), lambda b: clean_text(F.coalesce(b["text"], F.lit("")))), lambda t: t != "")
    row = lambda role, no, body: (F.lit(role).alias("role"), no.alias("nth"), body.alias("body"))
    human = user.select("session", "line_no", *row("user", F.lit(-1), F.array_join(texts, "\n")))
    results = F.filter(blocks(F.col("message")), lambda b: b["type"] == "tool_result")
    tools = user.select("session", "line_no", F.posexplode(F.transform(results, lambda b: _plain(b["content"]))).alias("nth", "body")).select("session", "line_no", F.lit("tool").alias("role"), "nth", "body")
    launch = lambda b: (b["type"] == "tool_use") & F.coalesce(b["name"], F.lit("")).isin("Agent", "Task")
    part = lambda b: F.when(b["type"] == "text", trim(F.coalesce(b["text"], F.lit("")))).when((b["type"] == "tool_use") & ~launch(b), F.concat(F.lit("→ "), tool_summary(F.coalesce(b["name"], F.lit("")), b["input"])))
    got = lambda b, k: F.nullif(trim(F.coalesce(F.get_json_object(b["input"], f"$.{k}"), F.lit(""))), F.lit(""))
    label = lambda b: head(F.coalesce(got(b, "description"), got(b, "subagent_type"), got(b, "prompt"), F.lit("subagent")), LAUNCH_CHARS)
    said = merged_blocks(parsed)
    mine = said.select("session", "line_no", *row("assistant", F.lit(-1), F.array_join(F.filter(F.transform("blocks", part), lambda t: t.isNotNull() & (t != "")), "\n")))
    marks = said.select("session", "line_no", F.posexplode(F.transform(F.filter("blocks", launch), label)).alias("nth", "body")).select("session", "line_no", F.lit("subagent").alias("role"), "nth", "body")
    told = F.when(F.col("type") == "pr-link", pr_link(F.col("prNumber"), F.col("prRepository"), F.col("prUrl"))).otherwise(trim(F.coalesce("content", F.lit(""))))
    system = parsed.where("type = 'pr-link' or type = 'system' and subtype = 'away_summary'").select("session", "line_no", *row("system", F.lit(0), told))
    rows = human.unionByName(tools).unionByName(mine).unionByName(marks).unionByName(system).where("body <> ''")
    order = W.partitionBy("session").orderBy("line_no", "nth")
    rows = rows.withColumn("no", F.row_number().over(order) - 1).withColumn("marker", F.sum((F.col("role") == "subagent").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    ids = agents.groupBy("session").agg(F.array_sort(F.collect_list("agent_id")).alias("ids"))
    sizes = rows.groupBy("session").agg(F.count_if(F.col("role") == "subagent").alias("markers"))
    paired = rows.join(sizes, "session").join(ids, "session", "left")
    agent = F.when((F.col("role") == "subagent") & (F.size("ids") == F.col("markers")), F.get("ids", F.col("marker") - 1))
    return paired.select("session", "no", "line_no", "role", "body", agent.alias("agent_id"), agent.isNotNull().alias("openable"))
