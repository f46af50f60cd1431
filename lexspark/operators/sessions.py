"""Session logs to turn pairs, transcripts and sliding-window chunks.

Log lines are rows (session, line_no, line); pairing is by islands: a message of the user, or a summary, begins a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import redact, trim
from .chunking import MAX_BYTES, has_code, oversized_chunks

#: Pairs of a window and its step; pairs and assistant bytes that make a session worth indexing.
WINDOW, STEP, MIN_PAIRS, MIN_BYTES, PROMPT_CHARS = 4, 3, 2, 200, 768
NOISE = r"(?s)<system-reminder>.*?</system-reminder>"
TAGS = r"(?s)<local-command-caveat>.*?</local-command-caveat>|<local-command-stdout>.*?</local-command-stdout>|<command-name>.*?</command-name>|<command-message>.*?</command-message>|<command-args>.*?</command-args>"
#: Tools whose use leaves a line, and the input that the line shows.
ENRICHED = (("Read", "file_path"), ("Write", "file_path"), ("Edit", "file_path"), ("Grep", "pattern"))
#: Tools whose prompt is text of the conversation.
PAL = tuple(f"mcp__pal__{x}" for x in "chat thinkdeep codereview consensus analyze debug planner challenge secaudit refactor".split())
AGENT, TASK = "Agent", "subagent task"

LINE = "type string, subtype string, uuid string, timestamp string, sessionId string, cwd string, gitBranch string, aiTitle string, prUrl string, prRepository string, prNumber string, content string, message string"


def text_of(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def clean_text(x: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(x, NOISE, ""), TAGS, ""))


def parse_lines(lines: DataFrame) -> DataFrame:
    """session, line_no, the fields of LINE with message as a variant, ts. Lines that are no JSON objects are skipped."""
    v = F.try_parse_json("line")
    fields = [x.split()[0] for x in LINE.split(", ") if not x.startswith("message")]
    parsed = lines.select("session", "line_no", v.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    got = parsed.select("session", "line_no", *[text_of(F.col("v"), f"$.{f}").alias(f) for f in fields], F.try_variant_get("v", "$.message", "variant").alias("message"))
    role = text_of(F.col("message"), "$.role")
    return got.withColumn("type", F.coalesce(F.nullif("type", F.lit("")), role)).withColumn("ts", F.try_to_timestamp("timestamp"))


def blocks(message: Column) -> Column:
    """array<struct<type, text, name, id, input, content>> of a message; a plain string is one text block."""
    content = F.try_variant_get(message, "$.content", "variant")
    many = F.try_variant_get(message, "$.content", "array<variant>")
    one = lambda b: F.struct(*[text_of(b, f"$.{k}").alias(k) for k in ("type", "text", "name", "id")], F.try_variant_get(b, "$.input", "variant").alias("input"), F.try_variant_get(b, "$.content", "variant").alias("content"))
    plain = F.try_variant_get(message, "$.content", "string")
    single = F.struct(F.lit("text").alias("type"), plain.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("variant").alias("input"), F.lit(None).cast("variant").alias("content"))
    return F.when(F.schema_of_variant(content) == "STRING", F.array(single)).otherwise(F.transform(many, one))


def merged_blocks(parsed: DataFrame) -> DataFrame:
    """Assistant messages with the blocks of all their snapshots, each once, at the place of the first: session, line_no, ts, blocks."""
    rows = parsed.where("type = 'assistant' and message is not null").withColumn("msg", F.coalesce(F.nullif(text_of(F.col("message"), "$.id"), F.lit("")), "uuid"))
    each = rows.select("session", "msg", "line_no", "ts", F.posexplode_outer(blocks(F.col("message"))).alias("no", "b"))
    same = W.partitionBy("session", "msg", "b.type", "b.text", "b.name", "b.id").orderBy("line_no", "no")
    first = each.withColumn("nth", F.row_number().over(same)).where("nth = 1")
    order = F.array_sort(F.collect_list(F.struct("line_no", "no", F.col("b.type").alias("type"), F.col("b.text").alias("text"), F.col("b.name").alias("name"), F.to_json("b.input").alias("input"))))
    return first.groupBy("session", "msg").agg(F.min("line_no").alias("line_no"), F.min_by("ts", "line_no").alias("ts"), order.alias("blocks"))


def _join(xs: Column) -> Column:
    return F.array_join(F.filter(xs, lambda t: t.isNotNull() & (t != "")), "\n")


def user_text(message: Column) -> Column:
    texts = F.filter(blocks(message), lambda b: b["type"] == "text")
    return _join(F.transform(texts, lambda b: clean_text(F.coalesce(b["text"], F.lit("")))))


def tool_line(name: Column, raw: Column) -> Column:
    """What the use of a known tool leaves: [Read: path]; null for other tools."""
    got = lambda k: F.get_json_object(raw, f"$.{k}")
    shown = F.lit(None).cast("string")
    for tool, key in ENRICHED:
        value = F.coalesce(got(key), F.lit(""))
        shown = F.when(name == tool, F.when(value == "", F.lit(f"[{tool}]")).otherwise(F.concat(F.lit(f"[{tool}: "), value, F.lit("]")))).otherwise(shown)
    agent = F.concat(F.lit("[Agent: "), _or(got("subagent_type"), AGENT), F.lit(" — "), _quoted(_or(got("description"), TASK)), F.lit("]"))
    return F.when(name == "Agent", agent).otherwise(shown)


def _or(x: Column, other: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(other))


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\\\])', r"\\$1"), F.lit('"'))


def promoted(name: Column, raw: Column) -> Column:
    """The prompt of a consulting tool is text of its own; null for other tools."""
    return F.when(name.isin(*PAL), F.left(F.coalesce(F.get_json_object(raw, "$.prompt"), F.lit("")), F.lit(PROMPT_CHARS)))


def messages(parsed: DataFrame) -> DataFrame:
    """session, line_no, ts, role (user, assistant, away_summary), text, tools, tool_lines."""
    none = F.array().cast("array<string>")
    users = parsed.where("type = 'user' and message is not null").select("session", "line_no", "ts", F.lit("user").alias("role"), user_text(F.col("message")).alias("text"), none.alias("tools"), none.alias("tool_lines")).where("text <> ''")
    away = parsed.where("type = 'system' and subtype = 'away_summary' and content <> ''").select("session", "line_no", "ts", F.lit("away_summary").alias("role"), trim("content").alias("text"), none.alias("tools"), none.alias("tool_lines"))
    part = lambda b: F.when(b["type"] == "text", trim(F.coalesce(b["text"], F.lit("")))).when(b["type"] == "tool_use", promoted(b["name"], b["input"]))
    known = lambda b: (b["type"] == "tool_use") & (tool_line(b["name"], b["input"]).isNotNull() | (promoted(b["name"], b["input"]) != ""))
    mine = merged_blocks(parsed).select(
        "session", "line_no", "ts", F.lit("assistant").alias("role"), _join(F.transform("blocks", part)).alias("text"),
        F.transform(F.filter("blocks", known), lambda b: b["name"]).alias("tools"),
        F.filter(F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: tool_line(b["name"], b["input"])), lambda t: t.isNotNull()).alias("tool_lines"),
    )
    return users.unionByName(away).unionByName(mine.where("text <> '' or size(tools) > 0"))


def turn_pairs(rows: DataFrame) -> DataFrame:
    """session, pair_no (from 0), human, assistant, tools, tool_lines, of messages.

    An island's first row is the user's text or a summary; assistants before any are dropped, and so are those after a
    summary. A pair needs text on both sides; a summary stands alone.
    """
    begins = F.col("role").isin("user", "away_summary")
    island = F.sum(begins.cast("int")).over(W.partitionBy("session").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    of = rows.withColumn("island", island).where("island > 0")
    texts = F.collect_list(F.when((F.col("role") == "assistant") & (F.col("text") != ""), F.struct("line_no", "text")))
    listed = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", c))), lambda x: x[c]))
    grouped = of.groupBy("session", "island").agg(
        F.min_by("role", "line_no").alias("first"), F.min_by("text", "line_no").alias("human"), F.array_join(F.transform(F.array_sort(texts), lambda x: x["text"]), "\n").alias("assistant"),
        listed("tools").alias("tools"), listed("tool_lines").alias("tool_lines"),
    )
    alone = F.col("first") == "away_summary"
    none = F.array().cast("array<string>")
    pairs = grouped.where(alone | (F.col("assistant") != "")).select(
        "session", "island", F.when(alone, "").otherwise(F.col("human")).alias("human"), F.when(alone, F.col("human")).otherwise(F.col("assistant")).alias("assistant"),
        F.when(alone, none).otherwise(F.col("tools")).alias("tools"), F.when(alone, none).otherwise(F.col("tool_lines")).alias("tool_lines"),
    )
    no = F.row_number().over(W.partitionBy("session").orderBy("island")) - 1
    return pairs.withColumn("pair_no", no).drop("island")


def with_subagents(pairs: DataFrame, agents: DataFrame) -> DataFrame:
    """Pairs of subagents (session, agent_id, agent_type, agent_description beside a pair's columns) after the main ones."""
    main = pairs.withColumns({"is_subagent": F.lit(False), "agent_id": F.lit(""), "agent_type": F.lit(""), "agent_description": F.lit("")})
    both = main.unionByName(agents.withColumn("is_subagent", F.lit(True)))
    no = F.row_number().over(W.partitionBy("session").orderBy("is_subagent", "agent_id", "pair_no")) - 1
    return both.withColumn("pair_no", no)


def subagent_pairs(lines: DataFrame, metas: DataFrame) -> DataFrame:
    """Pairs of subagents' logs (session, agent_id, line_no, line), as :func:`with_subagents` takes them. A log's meta file
    (session, agent_id, meta: JSON) names the agent's type and task; where there is none, or no JSON, both are empty."""
    one = lines.select(F.to_json(F.struct("session", "agent_id")).alias("session"), "line_no", "line")
    pairs = turn_pairs(messages(parse_lines(one))).withColumn("of", F.from_json("session", "session string, agent_id string"))
    v = F.try_parse_json("meta")
    known = metas.select("session", "agent_id", text_of(v, "$.agentType").alias("agent_type"), text_of(v, "$.description").alias("agent_description"))
    joined = pairs.select("of.session", "of.agent_id", "pair_no", "human", "assistant", "tools", "tool_lines").join(known, ["session", "agent_id"], "left")
    return joined.fillna("", ["agent_type", "agent_description"])


def sanitised(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("human", redact("human")).withColumn("assistant", redact("assistant")).withColumn("tool_lines", F.transform("tool_lines", redact))


def indexable(pairs: DataFrame) -> DataFrame:
    """session, pairs, assistant_bytes, indexable."""
    main = F.lit(True) if "is_subagent" not in pairs.columns else ~F.col("is_subagent")
    per = pairs.groupBy("session").agg(F.count_if(main).alias("pairs"), F.sum(F.when(main, F.octet_length("assistant")).otherwise(0)).alias("assistant_bytes"))
    return per.withColumn("indexable", (F.col("pairs") >= MIN_PAIRS) & (F.col("assistant_bytes") >= MIN_BYTES))


def render_pairs(pairs: DataFrame) -> DataFrame:
    """Adds text: the pair as it stands in a transcript. Consecutive pairs of one subagent stand in one block."""
    if "is_subagent" not in pairs.columns:
        pairs = pairs.withColumns({"is_subagent": F.lit(False), "agent_type": F.lit(""), "agent_description": F.lit("")})
    who = F.struct("is_subagent", "agent_type", "agent_description")
    w = W.partitionBy("session").orderBy("pair_no")
    marked = pairs.withColumn("opens", ~F.lag(who).over(w).eqNullSafe(who)).withColumn("closes", ~F.lead(who).over(w).eqNullSafe(who))
    head = F.concat(F.lit("--- Subagent: "), _or(F.col("agent_type"), AGENT), F.lit(" — "), _quoted(_or(F.col("agent_description"), TASK)), F.lit(" ---\n"))
    own = F.col("is_subagent")
    tools = F.array_join(F.transform("tool_lines", lambda t: F.concat(t, F.lit("\n"))), "")
    talk = F.concat(F.lit("Human: "), "human", F.lit("\nAssistant: "), "assistant", F.lit("\n"), tools)
    summary = F.concat(F.lit("[Session summary: "), "assistant", F.lit("]\n"))
    body = F.when(~own & (F.col("human") == ""), summary).otherwise(talk)
    text = F.concat(F.when(own & F.col("opens"), head).otherwise(""), body, F.when(own & F.col("closes"), "--- End subagent ---\n").otherwise(""))
    return marked.withColumn("text", text).drop("opens", "closes")


def transcripts(rendered: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair_no", "text"))), lambda x: x["text"]), "\n")
    return rendered.groupBy("session").agg(text.alias("transcript"), F.count("*").alias("pairs"))


def chunk_title(start_time: Column, first: Column, last: Column, tools: Column, agents: Column) -> Column:
    """Session <time> | Turns a-b [| Subagent: …][| PAL: …][| Tools: …], names each once and in order."""
    part = lambda label, names: F.when(F.size(names) == 0, "").otherwise(F.concat(F.lit(f" | {label}: "), F.array_join(names, ", ")))
    pal = F.transform(F.filter(tools, lambda t: F.startswith(t, F.lit("mcp__pal__"))), lambda t: F.substring(t, 11, 1000))
    other = F.filter(tools, lambda t: ~F.startswith(t, F.lit("mcp__pal__")))
    head = F.format_string("Session %s | Turns %d-%d", F.date_format(start_time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), first + 1, last + 1)
    return F.concat(head, part("Subagent", F.array_sort(F.array_distinct(agents))), part("PAL", F.array_distinct(pal)), part("Tools", F.array_distinct(other)))


def windows(rendered: DataFrame, starts_at: DataFrame, most: int = MAX_BYTES, split: bool = True) -> DataFrame:
    """session, chunk_no, title, content, has_code: the whole session if it is short, else windows of 4 pairs that overlap by one.

    ``starts_at``: session, start_time. With ``split``, a window over ``most`` bytes is split at blank lines.
    """
    sizes = rendered.groupBy("session").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 1).alias("bytes"))
    short = F.col("bytes") - 1 <= most
    first = F.when(short, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - WINDOW) / STEP)).cast("int") * STEP, F.lit(STEP)))
    spans = sizes.select("session", F.explode(first).alias("first"), "n", short.alias("short"))
    spans = spans.withColumn("last", F.when(F.col("short"), F.col("n") - 1).otherwise(F.least(F.col("first") + WINDOW - 1, F.col("n") - 1)))
    pairs = spans.select("session", "first", "last", F.explode(F.sequence("first", F.col("last").cast("int"))).alias("pair_no"))
    agents = F.when(F.col("is_subagent") & (F.col("agent_type") != ""), F.col("agent_type")) if "is_subagent" in rendered.columns else F.lit(None).cast("string")
    rows = pairs.join(rendered.withColumn("agent", agents).select("session", "pair_no", "text", "tools", "agent"), ["session", "pair_no"])
    inside = F.array_sort(F.collect_list(F.struct("pair_no", "text", "tools", "agent")))
    held = rows.groupBy("session", "first", "last").agg(inside.alias("xs")).join(starts_at, "session", "left")
    pick = lambda k: F.transform("xs", lambda x: x[k])
    titled = held.select("session", "first", trim(F.array_join(pick("text"), "\n")).alias("content"), chunk_title(F.col("start_time"), F.col("first"), F.col("last"), F.flatten(pick("tools")), F.filter(pick("agent"), lambda a: a.isNotNull())).alias("title"))
    if not split:
        no = F.row_number().over(W.partitionBy("session").orderBy("first")) - 1
        return titled.withColumn("chunk_no", no).select("session", "chunk_no", "title", "content", has_code(F.col("content")).alias("has_code"))
    big = F.octet_length("content") > most
    pieces = titled.withColumn("cut", oversized_chunks(F.when(big, F.col("content")), most))
    each = pieces.select("session", "first", "title", F.explode(F.coalesce(F.transform("cut", lambda c: c["content"]), F.array("content"))).alias("content")).where("content <> ''")
    no = F.row_number().over(W.partitionBy("session").orderBy("first")) - 1
    return each.withColumn("chunk_no", no).select("session", "chunk_no", "title", "content", has_code(F.col("content")).alias("has_code"))


def label(session: Column, start_time: Column) -> Column:
    return F.concat(F.lit("session:"), F.date_format(start_time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(":"), session)
