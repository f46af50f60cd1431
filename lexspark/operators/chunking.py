"""Chunkers: text to rows of title, content, has_code.

Plain text is chunked by built-in expressions. Markdown and JSON need state that runs through a text, so they go through an
Arrow UDF, one text at a time; so does the split of oversized pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, byte_prefix, trim

#: Sizes in bytes, lines and sections.
MAX_BYTES, LINES, OVERLAP, SECTIONS, SECTION_BYTES, TITLE_BYTES = 4096, 20, 2, (3, 200), 5000, 80
CODE_BLOCK = r"(?s)```[0-9A-Za-z_]*\n.*?```"
#: Fields that name an element of a JSON array, in order of preference.
IDENTITY = ("id", "name", "title", "path", "slug", "key", "label")

CHUNKS = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("has_code", T.BooleanType())]))
Chunk = tuple[str, str, bool]


def content_type(x: Column) -> Column:
    """json, markdown or plaintext. Of a text's pieces the fiftieth holds all that is left."""
    bare = trim(x)
    is_json = F.left(bare, F.lit(1)).isin("{", "[") & F.try_parse_json(bare).isNotNull()
    lines = F.transform(F.split(bare, "\n", 50), trim)
    marks = F.transform(lines, lambda t: t.startswith("#").cast("int") + t.startswith("```").cast("int") + F.contains(t, F.lit("](")).cast("int"))
    many = F.aggregate(marks, F.lit(0), lambda a, b: a + b) >= 2
    return F.when(is_json, "json").when(many, "markdown").otherwise("plaintext")


def has_code(x: Column) -> Column:
    return F.contains(x, F.lit("```")) & x.rlike(CODE_BLOCK)


def first_line(content: Column) -> Column:
    return byte_prefix(trim(F.substring_index(content, "\n", 1)), TITLE_BYTES)


def plain_pieces(docs: DataFrame, key: str, text: str = "text", lines_per_chunk: int = LINES) -> DataFrame:
    """key, chunk_no, title, content of plain texts: one chunk for a short text, blank-line sections if there are a few small
    ones, else windows of lines that overlap by two. Each step stands in a projection of its own, so that a text is split once."""
    step = max(lines_per_chunk - OVERLAP, 1)
    split = docs.select(key, F.col(text).alias("text_"), F.split(text, "\n").alias("lines_"))
    n = F.size("lines_")
    split = split.withColumn("parts_", F.when(n > lines_per_chunk, F.split("text_", rf"\n{SPACE}*\n")))
    few = F.size("parts_").between(*SECTIONS) & F.forall("parts_", lambda s: F.octet_length(s) <= SECTION_BYTES)
    split = split.withColumn("shape_", F.when(n <= lines_per_chunk, "whole").when(few, "sections").otherwise("windows"))
    starts = F.sequence(F.lit(0), F.ceil((n - lines_per_chunk) / step).cast("int") * step, F.lit(step))
    windows = F.transform(starts, lambda s: F.array_join(F.slice("lines_", s + 1, lines_per_chunk), "\n"))
    pieces = F.when(F.col("shape_") == "whole", F.array("text_")).when(F.col("shape_") == "sections", F.col("parts_")).otherwise(windows)
    row = lambda p, i: F.struct(i.alias("i"), trim(p).alias("content"))
    full = F.filter(F.transform(pieces, row), lambda r: (r["content"] != "") | (F.col("shape_") == "whole"))
    each = split.select(key, "shape_", n.alias("n_"), F.posexplode(full).alias("chunk_no", "r_")).select("*", F.col("r_.i").alias("i_"), F.col("r_.content").alias("content"))
    each = each.withColumn("first_", first_line(F.col("content")))
    start = F.col("i_") * step
    other = F.when(F.col("shape_") == "sections", F.format_string("Section %d", F.col("i_") + 1)).otherwise(F.format_string("Lines %d-%d", start + 1, F.least(start + lines_per_chunk, F.col("n_"))))
    title = F.when(F.col("shape_") == "whole", "Output").when(F.col("first_") == "", other).otherwise(F.col("first_"))
    return each.select(key, "chunk_no", title.alias("title"), "content")


_HEADING, _RULE, _BLANK, _CODE = re.compile(r"(#{1,4})[\t\n\f\r ]+(.+)"), re.compile(r"[-_*]{3,}[\t\n\f\r ]*"), re.compile(r"\n[\t\n\f\r ]*\n"), re.compile(r"```[0-9A-Za-z_]*\n.*?```", re.S)


def _coded(text: str) -> bool:
    return _CODE.search(text) is not None


def _size(text: str) -> int:
    return len(text.encode())


def split_oversized(text: str, title: str, most: int = MAX_BYTES) -> list[Chunk]:
    """Cut at blank lines; each further chunk begins with the last two lines of the one before (all of it, if shorter)."""
    done: list[str] = []
    held = ""
    for part in filter(None, map(str.strip, _BLANK.split(text))):
        if held and _size(held) + _size(part) + 2 > most:
            done.append(held)
            held = "\n".join(held.split("\n")[-OVERLAP:]) + "\n\n"
        held += ("\n\n" if held else "") + part
    return [(title, c, _coded(c)) for c in [*done, *([held] if held else [])]]


def _pieces(text: str, title: str, most: int) -> list[Chunk]:
    return [(title, text, _coded(text))] if _size(text) <= most else split_oversized(text, title, most)


def markdown(text: str, most: int = MAX_BYTES) -> list[Chunk]:
    """Sections between headings and rules, titled by their chain of headings; fenced lines are only text."""
    out: list[Chunk] = []
    chain = ["", "", "", ""]
    held: list[str] = []
    fenced = False

    def flush() -> None:
        body = "\n".join(held).strip()
        held.clear()
        if body:
            out.extend(_pieces(body, " > ".join(filter(None, chain)) or "Content", most))

    for line in text.split("\n"):
        bare = line.strip()
        fence = bare.startswith("```")
        heading = None if fence or fenced else _HEADING.fullmatch(bare)
        if fence:
            fenced = not fenced
        if heading:
            flush()
            level = len(heading[1])
            chain[level - 1 :] = [heading[2], *[""] * (4 - level)]
        elif not fence and not fenced and _RULE.fullmatch(bare):
            flush()
        else:
            held.append(line)
    flush()
    return out or ([("Content", text.strip(), _coded(text))] if text.strip() else [])


_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"}


def _number(x: float) -> str:
    """A number in its shortest form; whole ones without a point, very large and small ones with an exponent."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent and abs(x) >= 1e-6:
        return mantissa
    mantissa, _, exponent = f"{x!r}".partition("e") if exponent else f"{x:.17g}".partition("e")
    return f"{mantissa}e{exponent[0]}{exponent[1:].lstrip('0') or '0'}" if exponent else mantissa


def dump(value: object, indent: str | None = None, level: int = 0) -> str:
    """JSON with sorted keys, double numbers, and < > & escaped; ``indent`` puts each element on a line."""
    if isinstance(value, str):
        return "".join(_ESCAPES.get(c, c) for c in json.dumps(value, ensure_ascii=False))
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return _number(float(value))
    inner = "" if indent is None else "\n" + indent * (level + 1)
    outer = "" if indent is None else "\n" + indent * level
    if isinstance(value, dict):
        parts = [f"{dump(k)}:{'' if indent is None else ' '}{dump(value[k], indent, level + 1)}" for k in sorted(value)]
        return "{" + ",".join(inner + p for p in parts) + outer + "}" if parts else "{}"
    parts = [dump(v, indent, level + 1) for v in value]
    return "[" + ",".join(inner + p for p in parts) + outer + "]" if parts else "[]"


def _plain(value: object) -> str:
    """How an identity is written in a title."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool) or value is None or isinstance(value, (dict, list)):
        return dump(value)
    x = float(value)
    if x == int(x) and abs(x) < 1e6:
        return str(int(x))
    if 1e-4 <= abs(x) < 1e21 and len(f"{abs(x):.0f}") <= 6:
        return repr(x)
    mantissa, exponent = f"{x:.16e}".split("e")
    mantissa = repr(float(mantissa)).removesuffix(".0")
    shortest = min((f"{x:.{d}e}" for d in range(17) if float(f"{x:.{d}e}") == x), key=len, default=f"{mantissa}e{exponent}")
    return shortest if abs(x) >= 1e21 or abs(x) < 1e-4 or abs(x) >= 1e6 else repr(x)


def json_chunks(value: object, path: tuple[str, ...] = (), most: int = MAX_BYTES) -> list[Chunk]:
    """Small flat objects whole, other objects by sorted key, arrays in batches; titles are paths."""
    title = " > ".join(path) or "(root)"
    if isinstance(value, list):
        return _array_chunks(value, title, most)
    if not isinstance(value, dict):
        text = dump(value)
        return [(title, text, False)] if _size(text) > most else []
    pretty = dump(value, "  ")
    if not any(isinstance(v, (dict, list)) for v in value.values()) and _size(pretty) < most:
        return [(title, pretty, True)]
    out: list[Chunk] = []
    for key in sorted(value):
        below = (*path, key)
        out += json_chunks(value[key], below, most) or [(" > ".join(below), dump(value[key]), True)]
    return out


def _array_chunks(items: list, prefix: str, most: int) -> list[Chunk]:
    first = items[0] if items else None
    named = lambda v: isinstance(v, (str, int, float)) and not isinstance(v, bool)
    field = next((f for f in IDENTITY if isinstance(first, dict) and f in first and named(first[f])), None)
    batches: list[tuple[int, list]] = []
    size = 0
    for i, item in enumerate(items):
        n = _size(dump(item))
        if batches and size and size + n <= most or batches and not size:
            batches[-1][1].append(item)
            size += n
        else:
            batches.append((i, [item]))
            size = n
    return [(f"{prefix} > {_batch_name(start, batch, field)}", dump(batch, "  "), True) for start, batch in batches]


def _batch_name(start: int, batch: list, field: str | None) -> str:
    ids = [_plain(x[field]) for x in batch if isinstance(x, dict) and field in x] if field else []
    if len(ids) > 3:
        return f"{ids[0]}…{ids[-1]}"
    if ids:
        return ", ".join(ids)
    return f"[{start}]" if len(batch) == 1 else f"[{start}-{start + len(batch) - 1}]"


def chunk_json(text: str, most: int = MAX_BYTES) -> list[Chunk] | None:
    """None where the text is to be chunked as plain text."""
    try:
        return json_chunks(json.loads(text), (), most) or None
    except (ValueError, RecursionError):
        return None


#: Texts of a batch that are Python objects at once.
PART = 64


def in_parts(values: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """f of each value: of a batch of whole texts only a part is held as Python objects, beside the batch and its results."""
    parts = [pa.array(map(f, values.slice(i, PART).to_pylist()), kind) for i in range(0, len(values), PART)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _each(cut: Callable[[str], list[Chunk] | None]):
    kind = pa.list_(pa.struct([("title", pa.string()), ("content", pa.string()), ("has_code", pa.bool_())]))

    def rows(text: str | None) -> list[dict] | None:
        found = None if text is None else cut(text)
        return None if found is None else [{"title": a, "content": b, "has_code": d} for a, b, d in found]

    @F.arrow_udf(CHUNKS)
    def run(texts: pa.Array) -> pa.Array:
        return in_parts(texts, rows, kind)

    return run


def markdown_chunks(x: Column, most: int = MAX_BYTES) -> Column:
    return _each(lambda t: markdown(t, most))(x)


def json_text_chunks(x: Column, most: int = MAX_BYTES) -> Column:
    return _each(lambda t: chunk_json(t, most))(x)


def oversized_chunks(text: Column, most: int = MAX_BYTES) -> Column:
    return _each(lambda t: split_oversized(t, "", most))(text)


def chunk_plain(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, chunk_no (from 0), title, content, has_code, content_type of plain texts, with no Python."""
    return plain_pieces(docs, key, text).select("*", F.lit(False).alias("has_code"), F.lit("prose").alias("content_type"))


def chunk(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """As :func:`chunk_plain`, by each text's own type. Only Markdown and JSON texts are sent to Python."""
    typed = docs.select(key, F.col(text).alias("text")).withColumn("kind", content_type(F.col("text")))
    of = lambda k: F.when(F.col("kind") == k, F.col("text"))
    cut = typed.where("kind <> 'plaintext'").withColumn("c", F.coalesce(markdown_chunks(of("markdown")), json_text_chunks(of("json"))))
    plain = typed.where("kind = 'plaintext'").select(key, "text").union(cut.where("c is null").select(key, "text"))
    made = cut.where("size(c) > 0").select(key, F.posexplode("c").alias("chunk_no", "x")).select(key, "chunk_no", "x.title", "x.content", "x.has_code")
    whole = cut.where("size(c) = 0").select(key, F.lit(0).alias("chunk_no"), F.lit("Content").alias("title"), F.col("text").alias("content"), F.lit(False).alias("has_code"))
    parts = made.unionByName(whole).unionByName(plain_pieces(plain, key).withColumn("has_code", F.lit(False)))
    return parts.withColumn("content_type", F.when(F.col("has_code"), "code").otherwise("prose"))
