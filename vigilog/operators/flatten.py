"""Nested text to columns: parsing, schema discovery and generated projections."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import col_of


def parse_dict_text(text: Column) -> Column:
    """Variant of a dictionary text: JSON, or a printed dictionary with single quotes.

    Anything that is no object becomes null.
    """
    swapped = F.when(text.contains("'") & ~text.contains('"'), F.translate(text, "'", '"')).otherwise(text)
    # Only where the plain parse fails: quotes around single-quoted runs, then the three bare words.
    requoted = F.regexp_replace(text, r"'([^'\"]*)'", '"$1"')
    for word, json_word in (("True", "true"), ("False", "false"), ("None", "null")):
        requoted = F.regexp_replace(requoted, rf"([:\[,]\s*){word}(?=\s*[,}}\]])", f"$1{json_word}")
    # A parsed text that opens with a brace is an object; testing the text keeps the parse single.
    return F.when(text.rlike(r"^\s*\{"), F.coalesce(F.try_parse_json(swapped), F.try_parse_json(requoted)))


@dataclass(frozen=True)
class Leaf:
    """A value found in nested data: its key path and kind."""

    path: tuple[str, ...]
    kind: T.DataType

    @property
    def json_path(self) -> str:
        return "$" + "".join(f'["{key}"]' for key in self.path)


def discover_all(df: DataFrame, columns: Sequence[str]) -> dict[str, T.DataType]:
    """Common type of each variant column, found in one aggregation over the data."""
    row = df.agg(*[F.schema_of_variant_agg(col_of(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    spark, found = df.sparkSession, {}
    for i, name in enumerate(columns):
        ddl = re.sub(r"\bOBJECT\b", "STRUCT", row[f"s{i}"] or "VOID").replace("STRUCT<>", "STRING").replace("VOID", "STRING")
        found[name] = spark.range(0).select(F.lit(None).cast(ddl).alias("x")).schema["x"].dataType
    return found


def discover(df: DataFrame, column: str) -> T.DataType:
    return discover_all(df, [column])[column]


def leaves(kind: T.DataType, prefix: tuple[str, ...] = (), depth: int = 64) -> list[Leaf]:
    """Leaf values down to ``depth`` levels; what lies deeper stays one value."""
    if isinstance(kind, T.StructType) and depth > 0:
        found = []
        for part in kind.fields:
            found += leaves(part.dataType, (*prefix, part.name), depth - 1)
        return found
    return [Leaf(prefix, kind)]


def _value(column: Column, leaf: Leaf, long_lists: int | None) -> Column:
    if isinstance(leaf.kind, T.ArrayType):
        items = F.try_variant_get(column, leaf.json_path, "array<string>")
        joined = F.array_join(items, ", ", "None")
        if long_lists is None:
            return joined
        return F.when(F.size(items) > long_lists, F.concat(
            F.lit("["), F.size(items).cast("string"), F.lit(" items]"))).otherwise(joined)
    if isinstance(leaf.kind, (T.StructType, T.VariantType)):
        return F.try_variant_get(column, leaf.json_path, "string")
    kind = leaf.kind
    if isinstance(kind, (T.DecimalType, T.FloatType)):
        kind = T.DoubleType()
    return F.try_variant_get(column, leaf.json_path, kind.simpleString())


def flatten(
    df: DataFrame, columns: Sequence[str], sep: str = "_", depth: int = 64, long_lists: int | None = None,
    kinds: dict[str, T.DataType] | None = None,
) -> DataFrame:
    """Replace variant columns by one column per leaf, next to the other columns, in one projection.

    ``kinds`` gives the types when they are known; otherwise one pass finds them. No join is needed:
    all parts come from the same row.
    """
    unknown = [c for c in columns if c not in (kinds or {})]
    kinds = {**(kinds or {}), **(discover_all(df, unknown) if unknown else {})}
    parts: list[Column] = [col_of(c) for c in df.columns if c not in columns]
    for name in columns:
        for leaf in leaves(kinds[name], depth=depth):
            if leaf.path:
                parts.append(_value(col_of(name), leaf, long_lists).alias(sep.join((name, *leaf.path))))
    return df.select(*parts)


def flatten_text(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """Parse dictionary texts and flatten them."""
    parsed = df.withColumns({c: parse_dict_text(col_of(c)) for c in columns})
    return flatten(parsed, columns, **options)


def path_value(column: Column, path: str, kind: str = "string") -> Column:
    """Value at a dotted path of a variant column; null when the path is missing."""
    return F.try_variant_get(column, Leaf(tuple(path.split(".")), T.StringType()).json_path, kind)


def hits_to_rows(df: DataFrame, source: str = "source", **options) -> DataFrame:
    """Hits (id, index, nested source) to flat rows, keeping id and index."""
    flat = flatten(df, [source], **options)
    start = source + options.get("sep", "_")
    return flat.select(*[
        col_of(c).alias(c[len(start):] if c.startswith(start) else c) for c in flat.columns
    ])


def observed_types(df: DataFrame, column: str) -> DataFrame:
    """Field paths of a variant column, to whatever depth there is, with the kinds of value seen and how often."""
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    level = df.select(F.lit(column).alias("field"), col_of(column).alias("value")).filter(F.col("value").isNotNull())
    parts = []
    spark, nested = df.sparkSession, discover(df, column)
    while True:
        seen = level.select("field", "value", kind(F.col("value")).alias("type"))
        parts.append(seen.groupBy("field", "type").agg(F.count(F.lit(1)).alias("n")))
        inner = spark.tvf.variant_explode(F.col("value").outer()).select(
            F.col("key"), F.col("value").alias("inner_value"))
        if not _has_depth(nested, len(parts)):
            break
        level = seen.filter(F.col("type") == "OBJECT").lateralJoin(inner).select(
            F.concat_ws(".", "field", "key").alias("field"), F.col("inner_value").alias("value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _has_depth(kind: T.DataType, levels: int) -> bool:
    if levels == 0:
        return True
    return isinstance(kind, T.StructType) and any(_has_depth(f.dataType, levels - 1) for f in kind.fields)
