"""Benchmark decontamination by spaced-seed hashing, in built-in functions only.

A mask names the positions of a span that count; the others are ignored, so a changed word under one of them costs no hit.
An item is leaked into a text if, along one alignment, ``similarity`` of all its words agree, or ``similarity`` of any
``window`` consecutive ones (an overlap). Two families of seeds hit every such alignment:

* whole items: an item of n words of which at most k may be changed is cut into k + 1 seeds that share no word: neighbouring
  seeds lie in one another's gaps (every second word, or every third where a seed is left over), and an item of which no word
  may be changed is one seed. However the changed words lie, one seed at least is whole, at any length.
* overlaps: of a window in which c words may be changed, the c + 1 interleaved seeds of every (c + 1)th word share no word
  either, so one of them is whole. An item has such a seed at each of its positions.

Items are hashed at their seeds, texts at each position under each mask that the items use, and both are joined on the hash.
Every hit fixes an alignment, along which the whole item and the windows around the hit are compared word by word.

Spark gathers all rows that a join makes of one row before it passes them on: texts are cut into blocks first, with as many
words of their neighbours as the longest item has, and a hit takes along the words that stand along it, not the text.

The item side is broadcast if its bytes, counted first, are at most ``most_bytes``; else hashes are joined like any table, in
rows of a few numbers, and words are fetched for the hits alone. Words are runs of letters and digits, in lower case. Defined
cases: an item of few words matches like any other, one of a single word wherever that word stands; items shorter than a
window have no overlaps; null and empty texts have no words and match nothing; a null doc_id stays null; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked
from .licenses import words_of

#: Most words of a seed: a part of a whole seed is whole too.
WEIGHT = 8
#: Words of a text whose hits are gathered at once; more where items are longer.
BLOCK = 256


def _words(text: str) -> Column:
    return F.split(F.btrim(F.lower(words_of(F.col(text)))), " ")


def _picked(j: Column, stride: Column, weight: Column) -> Column:
    words = F.transform(F.sequence(F.lit(0), weight - 1), lambda k: F.get("item", j + k * stride))
    return F.xxhash64(stride, weight, words)


def _whole_seeds(tests: DataFrame, similarity: float) -> DataFrame:
    """item_id, j (position of the seed's first word), stride, weight, hash: the seeds that share no word."""
    n = F.size("item")
    changed = F.least(n - 1, F.floor(n * F.lit(1 - similarity) + F.lit(1e-9)).cast("int"))
    cut = tests.withColumn("seeds", changed + 1).withColumn("length", F.floor(n / F.col("seeds")).cast("int"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("seeds") - 1)).alias("p"))
    # an odd number of seeds begins with three in one block, the others go in pairs
    three = F.when(F.col("seeds") % 2 == 0, 0).otherwise(F.least("seeds", F.lit(3)))
    rest = F.col("p") - three
    j = F.when(rest < 0, F.col("p")).otherwise(three * F.col("length") + F.floor(rest / 2).cast("int") * 2 * F.col("length") + rest % 2)
    stride = F.when(rest < 0, three).otherwise(2)
    placed = cut.select("item_id", "item", j.cast("int").alias("j"), stride.cast("int").alias("stride"), F.least("length", F.lit(WEIGHT)).cast("int").alias("weight"))
    return placed.select("item_id", "j", "stride", "weight", _picked(F.col("j"), F.col("stride"), F.col("weight")).alias("hash"))


class Window:
    """The overlaps that count: ``words`` of an item of which ``changed`` may differ, and the mask that finds them."""

    def __init__(self, words: int, similarity: float):
        self.words, self.changed = words, int(words * (1 - similarity) + 1e-9)
        self.stride = self.changed + 1
        self.weight = words // self.stride
        self.span = self.stride * (self.weight - 1) + 1

    def seeds(self, tests: DataFrame) -> DataFrame:
        """As _whole_seeds, at each position of the items that have a window."""
        long = tests.where(F.size("item") >= self.words)
        placed = long.select("item_id", "item", F.explode(F.sequence(F.lit(0), F.size("item") - self.span)).alias("j"))
        stride, weight = F.lit(self.stride), F.lit(self.weight)
        return placed.select("item_id", "j", stride.alias("stride"), weight.alias("weight"), _picked(F.col("j"), stride, weight).alias("hash"))

    def starts(self) -> Column:
        """Where in the item the windows begin that hold the hit and agree."""
        first, last = F.greatest(F.lit(0), F.col("j") + (self.span - self.words)), F.least(F.col("j"), F.size("item") - self.words)
        agree = lambda a: F.size(F.filter(F.sequence(F.lit(0), F.lit(self.words - 1)), lambda k: _agrees(F.get("item", a + k), a + k))) >= self.words - self.changed
        return F.when(first <= last, F.filter(F.sequence(first, last), agree)).otherwise(F.array().cast("array<int>"))


def _blocks(texts: DataFrame, reach: int) -> DataFrame:
    """The columns of ``texts`` but w; then of each block ``w``, its words with ``reach`` more on either side, ``at`` (place of w's
    first word in the text), and ``first`` and ``last``, which of w are the block's own."""
    n = max(BLOCK, reach)

    def cut(b: Column) -> Column:
        at = F.greatest(F.lit(0), b - reach)
        return F.struct(at.alias("at"), (b - at).alias("first"), (F.least(b + n, F.size("w")) - at - 1).alias("last"), F.slice("w", at + 1, b - at + n + reach).alias("w"))

    return texts.select(*[c for c in texts.columns if c != "w"], F.inline(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(n)), cut)))


def _positions(blocks: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """A row for each of a block's own positions and each mask (stride, weight): ``i`` (in w) and ``hash``."""
    words = lambda stride, weight: [F.get("w", F.col("i") + F.lit(k * stride)) for k in range(weight)]
    hashes = F.array(*[F.when(F.col("i") + stride * (weight - 1) < F.size("w"), F.xxhash64(F.lit(stride), F.lit(weight), *words(stride, weight))) for stride, weight in masks])
    every = blocks.select("*", F.explode(F.sequence("first", "last")).alias("i"))
    return every.select("*", F.explode(hashes.cast("array<bigint>")).alias("hash"))


def _alongside(hits: DataFrame) -> DataFrame:
    """Hits (at, w, i, item, j) with ``begin`` (where in the text the item's first word stands), ``before`` (its words before the text)
    and ``span``, the text's words along the others."""
    begin, before = F.col("i") - F.col("j"), F.greatest(F.lit(0), F.col("j") - F.col("i"))
    span = F.slice("w", F.greatest(F.lit(0), begin) + 1, F.size("item") - before)
    return hits.select("doc_id", "item_id", "item", "j", (F.col("at") + begin).alias("begin"), before.alias("before"), span.alias("span"))


def leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, window: int = 13, most_bytes: int = 64 << 20) -> DataFrame:
    """The leaked items of each text: doc_id, item_id, similarity of the whole item along its best alignment, begin (word of the
    text where its first word stands there), hits (seeds' places) of that alignment, covered (words of the item in overlaps, of all alignments)."""
    overlap = Window(window, similarity)
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), _words("text").alias("item")).where("item[0] != ''").distinct()
    # an item_id with several texts has a number for each
    tests = tests.select(F.xxhash64("item_id", "item").alias("key"), "item_id", "item")
    keyed = tests.select(F.col("key").alias("item_id"), "item")
    seeds = _whole_seeds(keyed, similarity).union(overlap.seeds(keyed)).distinct()
    used = seeds.groupBy("stride", "weight").count().orderBy("stride", "weight").collect()  # at most four strides by WEIGHT weights
    held, reach = tests.agg(F.sum(F.octet_length(F.array_join("item", " ")) + 16 * F.size("item")), F.max(F.size("item"))).first()
    size, reach = 48 * sum(r["count"] for r in used) + (held or 0), reach or 0
    masks = [(r.stride, r.weight) for r in used]
    seeds = seeds.select("hash", F.col("item_id").alias("key"), "j")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words("text").alias("w"))
    if size <= most_bytes:
        hits = _positions(_blocks(texts, reach), masks).join(F.broadcast(seeds), "hash").join(F.broadcast(tests), "key")
    else:
        rows = texts.withColumn("row", F.xxhash64("doc_id", "w")).dropDuplicates(["row"])
        slim = _positions(_blocks(rows.select("row", "w"), reach), masks).select("row", (F.col("at") + F.col("i")).alias("i"), "hash")
        hits = slim.join(seeds, "hash").select("row", "key", "i", "j").distinct().join(tests, "key").join(rows, "row").withColumn("at", F.lit(0))
    # the comparison sits in a generator: as a filter it would move into the join and take that out of generated code
    compared = F.struct((_same() / F.size("item")).alias("similarity"), overlap.starts().alias("starts"))
    good = F.filter(F.array(compared), lambda c: (c["similarity"] >= similarity) | (F.size(c["starts"]) > 0))
    checked = _alongside(hits).select("doc_id", "item_id", "begin", "j", F.explode(good).alias("c")).select("doc_id", "item_id", "begin", "j", "c.*")
    # distinct starts and places are no more than the item's words, however often the text repeats them
    starts = F.flatten(F.collect_set("starts"))
    found = checked.groupBy("doc_id", "item_id", "begin").agg(F.max("similarity").alias("similarity"), F.size(F.collect_set("j")).cast("long").alias("hits"), F.array_sort(F.array_distinct(starts)).alias("starts"))
    best = F.max(F.struct("similarity", (-F.col("begin")).alias("minus"), "hits")).alias("best")
    each = found.groupBy("doc_id", "item_id").agg(best, F.array_distinct(starts).alias("starts"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda a: F.sequence(a, a + (window - 1))))))
    return each.select("doc_id", "item_id", "best.similarity", (-F.col("best.minus")).cast("int").alias("begin"), "best.hits", covered.alias("covered"))


def _agrees(word: Column, k: Column) -> Column:
    """Whether the item's word k stands at its place in the text; those before or after the text count as changed."""
    at = k - F.col("before")
    return (at >= 0) & F.get("span", F.greatest(F.lit(0), at)).eqNullSafe(word)


def _same() -> Column:
    """How many of an item's words stand along the alignment."""
    return F.size(F.filter(F.transform("item", _agrees), lambda x: x))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without leaked items, in their columns. Rows with a null doc_id are told apart by their text."""
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    bad = leaks(docs.select(key.alias("doc_id"), "text"), items, **how).select(F.col("doc_id").alias("key")).distinct()
    return unpacked(packed(docs, key.alias("key")).join(bad, "key", "left_anti"), docs.columns)
