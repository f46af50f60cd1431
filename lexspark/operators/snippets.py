"""Snippets around hits, result budgets, summaries for an intent."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import byte_prefix, col, one_decimal, trim

#: Reach of a window, bytes of a snippet, of all output, and of a preview.
REACH, SNIPPET_BYTES, OUTPUT_BYTES, PREVIEW_BYTES = 300, 1500, 40 * 1024, 120


def _places(low: str, terms) -> list[int]:
    found = set()
    for t in terms:
        at = low.find(t) if t else -1
        while at >= 0:
            found.add(at)
            at = low.find(t, at + 1)
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def positions(content: pd.Series, terms: pd.Series) -> pd.Series:
    """Where each term starts (from 0, overlaps included), each place once and sorted. Offsets are characters; one search
    through a text for each term, whose cost is linear."""
    return pd.Series([None if c is None else _places(c.lower(), ts) for c, ts in zip(content, terms, strict=True)], dtype=object)


def split_terms(query: Column | str) -> Column:
    return F.filter(F.split(trim(F.lower(col(query))), r"\s+"), lambda t: F.octet_length(t) > 2)


def merged_windows(at: list[int], length: int, reach: int = REACH) -> list[tuple[int, int]]:
    """(start, end) around sorted positions, merged where they touch."""
    out: list[tuple[int, int]] = []
    for p in at:
        start, end = max(0, p - reach), min(length, p + reach)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def cut(text: str, terms: list[str], most: int, reach: int) -> str:
    """The windows around the terms until ``most`` characters are shown, … where text is left out; the start, if there is no hit."""
    if len(text) <= most:
        return text
    parts, total = [], 0
    for start, end in merged_windows(_places(text.lower(), terms), len(text), reach):
        if total >= most:
            break
        size = min(end - start, most - total)
        parts.append(("…" if start else "") + text[start : start + size] + ("…" if end < len(text) else ""))
        total += size
    return "\n\n".join(parts) if parts else text[:most] + "\n…"


def snippet(content: Column | str, query: Column | str, most: int = SNIPPET_BYTES, reach: int = REACH) -> Column:
    """The windows around the query's words, see :func:`cut`; linear in the text."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut(t, list(ts), most, reach) for t, ts in zip(texts, terms, strict=True)], dtype=object)

    return run(col(content), split_terms(query))


def window_rows(hits: DataFrame, reach: int = REACH) -> DataFrame:
    """As merged_windows over rows (id, pos, length): id, start, end."""
    w = W.partitionBy("id").orderBy("pos")
    spans = hits.withColumn("start", F.greatest(F.lit(0), F.col("pos") - reach)).withColumn("end", F.least("length", F.col("pos") + reach))
    before = F.lag("end").over(w)
    marked = spans.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("id", "start", "end")


def within_budget(sections: DataFrame, most: int = OUTPUT_BYTES) -> DataFrame:
    """Sections (request, query_no, text) up to the one that passes the budget."""
    before = F.coalesce(F.sum(F.octet_length("text")).over(W.partitionBy("request").orderBy("query_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sections.withColumn("before", before).where(F.col("before") < most).drop("before")


def preview(content: Column | str) -> Column:
    return byte_prefix(F.substring_index(col(content), "\n", 1), PREVIEW_BYTES)


def intent_summary(results: DataFrame, terms: DataFrame, facts: DataFrame) -> DataFrame:
    """source_id, summary: sizes, titles with previews of what was found, distinctive terms."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("  - "), "title", F.lit(": "), preview("content")).alias("t")))), lambda x: x["t"]), "\n")
    found = results.groupBy("source_id").agg(listed.alias("listed"), F.count("*").alias("n"))
    words = terms.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ", ").alias("words"))
    joined = facts.join(found, "source_id", "left").join(words, "source_id", "left")
    head = F.format_string("Indexed %d sections from \"%s\" into knowledge base.\n%d sections matched (%d lines, %sKB):\n\n", "chunks", "label", F.coalesce("n", F.lit(0)), "lines", one_decimal(F.col("bytes") / 1024))
    tail = F.when(F.col("words").isNull(), "").otherwise(F.concat(F.lit("\n\nSearchable terms: "), "words"))
    return joined.select("source_id", F.concat(head, F.coalesce("listed", F.lit("")), tail).alias("summary"))
