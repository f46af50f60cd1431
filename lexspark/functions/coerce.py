"""Loosely typed JSON values (variants) as what they are meant for: lists of strings, and lists of commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v) == kind


def _inner(v: Column) -> Column:
    """A string that holds JSON is that JSON."""
    return F.try_parse_json(F.try_variant_get(v, "$", "string"))


def _string(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def strings(value: Column | str) -> Column:
    """The strings of an array (other elements go), or of a string with a JSON array of nothing but strings and nulls (empty
    strings); null for all else."""
    v = col(value)
    items = lambda x: F.try_variant_get(x, "$", "array<variant>")
    packed = items(_inner(v))
    whole = F.forall(packed, lambda x: _is(x, "STRING") | _is(x, "VOID"))
    direct = F.filter(F.transform(items(v), _string), lambda s: s.isNotNull())
    return F.when(_is(v, "STRING"), F.when(whole, F.transform(packed, lambda x: F.coalesce(_string(x), F.lit(""))))).otherwise(direct)


def commands(value: Column | str) -> Column:
    """array<struct<label, command>> of an array of objects or plain strings, or of a string with such JSON. Labels that are
    missing are cmd_1, cmd_2 … by place; objects without a command go. Null for all else."""
    v = col(value)
    items = F.try_variant_get(F.when(_is(v, "STRING"), _inner(v)).otherwise(v), "$", "array<variant>")
    field = lambda x, k: F.coalesce(_string(F.try_variant_get(x, f"$.{k}", "variant")), F.lit(""))

    def one(x: Column, i: Column) -> Column:
        name = F.concat(F.lit("cmd_"), (i + 1).cast("string"))
        plain = F.struct(name.alias("label"), _string(x).alias("command"))
        made = F.struct(F.coalesce(F.nullif(field(x, "label"), F.lit("")), name).alias("label"), field(x, "command").alias("command"))
        return F.when(_is(x, "STRING"), plain).when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")) & (field(x, "command") != ""), made)

    return F.filter(F.transform(items, one), lambda c: c.isNotNull())
