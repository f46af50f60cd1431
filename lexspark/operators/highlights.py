"""Where a query's words stand in the chunks that were found: in bytes, from the places that the index stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.porter import stem_udf
from ..functions.text import col, word_tokens
from . import index

#: What stands around a hit.
BEGIN, END = "\x02", "\x03"
#: A token of the index in a text as it is written: the capital I with a dot ends one, since lower case makes two characters of it.
TOKEN = r"[\p{L}\p{N}\p{Co}&&[^İ]]*İ|[\p{L}\p{N}\p{Co}&&[^İ]]+"


def token_bytes(chunks: DataFrame) -> DataFrame:
    """chunk_id, pos, start, end of the tokens of chunk_id, content: bytes from 0, the end left out."""
    parts = F.arrays_zip(F.transform(F.split("content", TOKEN, -1), F.octet_length).alias("gap"), F.transform(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0)), F.octet_length).alias("size"))
    each = chunks.select("chunk_id", F.posexplode(parts).alias("pos", "p")).select("chunk_id", "pos", "p.gap", "p.size")
    upto = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(W.partitionBy("chunk_id").orderBy("pos"))
    # behind the last token stands a gap alone
    return each.withColumn("end", upto).where("size is not null").select("chunk_id", "pos", (F.col("end") - F.col("size")).alias("start"), "end")


def places(stored: index.Stored, found: DataFrame, groups: DataFrame) -> DataFrame:
    """query_id, chunk_id, first, last: places of the tokens of the queries' terms (query_id, group_no, term) in the contents of
    ``found`` (query_id, chunk_id). A term of several tokens counts where they stand in a row."""
    wanted = groups.select("query_id", "term", word_tokens("term").alias("tokens")).distinct()
    wanted = wanted.select("query_id", "term", F.size("tokens").alias("n"), F.posexplode("tokens").alias("no", "token")).withColumn("stem", stem_udf("token")).drop("token")
    stems = [r[0] for r in wanted.select("stem").distinct().limit(index.MAX_TERMS + 1).collect()]
    if len(stems) > index.MAX_TERMS:
        raise ValueError(f"a batch of queries may hold {index.MAX_TERMS} distinct stems")
    pairs = found.select("query_id", "chunk_id").distinct()
    at = stored.places(stems).where("col = 1").select("stem", "chunk_id", "pos").join(pairs, "chunk_id")
    met = at.join(F.broadcast(wanted), ["query_id", "stem"]).withColumn("first", F.col("pos") - F.col("no"))
    runs = met.groupBy("query_id", "chunk_id", "term", "n", "first").agg(F.count_distinct("no").alias("met")).where("met = n")
    return runs.select("query_id", "chunk_id", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def marks(stored: index.Stored, found: DataFrame, groups: DataFrame) -> DataFrame:
    """query_id, chunk_id, content, marks: (start, end) in bytes of what the query hits, in order; hits that share a token are one.
    Only chunks with hits have a row."""
    order = W.partitionBy("query_id", "chunk_id").orderBy("first", "last")
    runs = places(stored, found, groups)
    before = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = runs.withColumn("new", (before.isNull() | (F.col("first") > before)).cast("int")).withColumn("island", F.sum("new").over(order))
    whole = islands.groupBy("query_id", "chunk_id", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    texts = stored.texts(whole.select("chunk_id").distinct(), "content")
    sizes = token_bytes(texts)
    begun = whole.join(sizes.select("chunk_id", F.col("pos").alias("first"), "start"), ["chunk_id", "first"])
    both = begun.join(sizes.select("chunk_id", F.col("pos").alias("last"), "end"), ["chunk_id", "last"])
    listed = both.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("marks"))
    return listed.join(texts, "chunk_id").select("query_id", "chunk_id", "content", "marks")


def highlighted(content: Column | str, marks: Column | str) -> Column:
    """The content with its marks between BEGIN and END."""
    raw, marks = F.encode(col(content), "UTF-8"), col(marks)
    cut = lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8")
    before = lambda i: F.coalesce(F.get(marks, i - 1)["end"], F.lit(0))
    parts = F.transform(marks, lambda m, i: F.concat(cut(before(i), m["start"]), F.lit(BEGIN), cut(m["start"], m["end"]), F.lit(END)))
    return F.concat(F.array_join(parts, ""), cut(before(F.size(marks)), F.octet_length(raw)))


def stripped(text: Column | str) -> Column:
    """A highlighted text without its marks."""
    return F.translate(col(text), BEGIN + END, "")


def span(content: Column | str, marks: Column | str, groups: Column | str) -> Column:
    """The shortest stretch, from start to start in bytes, that holds a mark of each group (an array of arrays of terms): those
    whose text, in lower case, holds a term of it. Null where a group has none. One pass over the marks in order."""
    raw, groups = F.encode(col(content), "UTF-8"), col(groups)
    text = lambda m: F.lower(F.decode(F.substring(raw, m["start"] + 1, m["end"] - m["start"]), "UTF-8"))
    inside = lambda m: F.transform(groups, lambda g: F.exists(g, lambda t: F.contains(text(m), t)))
    events = F.transform(col(marks), lambda m: F.struct(m["start"].alias("at"), inside(m).alias("of")))
    none = F.lit(-1).cast("long")

    def step(s: Column, e: Column) -> Column:
        last = F.zip_with(s["last"], e["of"], lambda x, hit: F.when(hit, e["at"]).otherwise(x))
        width = e["at"] - F.array_min(last)
        best = F.when(F.array_min(last) < 0, s["best"]).when((s["best"] < 0) | (width < s["best"]), width).otherwise(s["best"])
        return F.struct(last.alias("last"), best.alias("best"))

    start = F.struct(F.array_repeat(none, F.size(groups)).alias("last"), none.alias("best"))
    return F.nullif(F.aggregate(events, start, step, lambda s: s["best"]), none)
