"""Project folders by their mangled names, in which each / and . of a path has become -."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col


def mangled(path: Column | str) -> Column:
    return F.translate(col(path), "/.", "--")


def _key(name: Column) -> Column:
    """What names and all the paths that they may stand for have in common: a - that begins a part may be missing or be there twice."""
    return F.rtrim(F.regexp_replace(name, "-+", "-"), F.lit("-"))


def unmangled(names: DataFrame, folders: DataFrame) -> DataFrame:
    """project_dir, path of distinct names (project_dir): the folder (path) that a name stands for, null if there is none.

    A name's parts between - are joined again, from the left: a folder's own name is one part (perhaps with a . before it),
    or several with - or with . between all of them, and an empty part may stand for nothing. Of several folders that a name
    may stand for, the one with fewer parts in its first name counts, then that with - before that with . between them or
    before it, and so on to the right. Folders are met by an equal key, of one join; whether they fit and in what order is
    then told by each alone."""
    wanted = names.select("project_dir").distinct()
    known = folders.select(F.col("path").alias("folder")).where(F.startswith("folder", F.lit("/"))).distinct().withColumn("key", _key(mangled("folder")))
    met = wanted.where(F.startswith("project_dir", F.lit("-"))).withColumn("key", _key(F.col("project_dir"))).join(known, "key")
    steps = F.filter(F.split("folder", "/"), lambda s: s != "")
    met = met.withColumn("steps", steps)
    mixed = F.exists("steps", lambda s: F.contains(s, F.lit("-")) & F.contains(s, F.lit(".")))
    hidden = lambda s: s.rlike(r"^\.[^.]*$")
    quoted = lambda s: F.concat(F.lit(r"\Q"), F.translate(F.when(hidden(s), F.ltrim(s, F.lit("."))).otherwise(s), ".", "-"), F.lit(r"\E"))
    # the empty parts before each step, and behind the last, are the groups of the pattern
    pattern = F.concat(F.lit("^"), F.array_join(F.transform("steps", lambda s: F.concat(F.lit("-(-*)"), quoted(s))), ""), F.when(F.size("steps") == 0, "-").otherwise(""), F.lit("(-*)$"))
    fits = met.where(~mixed).withColumn("pattern", pattern).where(F.expr("project_dir rlike pattern"))
    empty = F.expr("transform(sequence(1, size(steps) + 1), i -> length(regexp_extract(project_dir, pattern, i)))")
    parts = lambda s, by: F.size(F.split(s, by)) * 3
    choice = lambda s: F.when(hidden(s), 5).when(F.contains(s, F.lit(".")), parts(s, r"\.") + 1).otherwise(parts(s, "-"))
    choices = F.concat(F.transform("steps", choice), F.array(F.lit(None).cast("int")))
    taken = F.flatten(F.zip_with("empty", "choices", lambda n, c: F.concat(F.array_repeat(F.lit(3), n), F.when(c.isNull(), F.array().cast("array<int>")).otherwise(F.array(c)))))
    best = fits.withColumn("empty", empty).withColumn("choices", choices).groupBy("project_dir").agg(F.min(F.struct(taken.alias("taken"), "folder"))["folder"].alias("path"))
    return wanted.join(best, "project_dir", "left")
