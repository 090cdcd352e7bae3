"""Catalogues of tools described by JSON schemas: parameters, shapes, names, and descriptions that tell nothing apart.

A tool is (key, name, description, schema): schema is JSON text with `properties` and `required`. Documents are parsed once, as
VARIANT, whatever their shape; a schema that isn't JSON has no parameters.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that refer to what the reader can't see; where a description's summary ends.
FORBIDDEN = ("prd", "previous message", "see ", "above", "below", "brevity", "todo", "as described", "same as", "tbd")
SECTIONS = "Args|Returns|Parameters"


def summary(description: Column) -> Column:
    """What stands before the sections on arguments, on one line."""
    line = F.regexp_replace(F.coalesce(description, F.lit("")), "\n", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(line, rf"(?s)\b({SECTIONS})\b.*", ""), "[ \t\r\n\f\x0b]+", " "))


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"[_\W]+"), lambda t: t != "")


def parameters(tools: DataFrame, key: str, schema: str) -> DataFrame:
    """(key, param, type, required, described, opaque): a row for each property of each schema. opaque: an object without
    properties, or an array of such objects."""
    doc = tools.select(key, F.try_parse_json(F.col(schema)).alias("_v")).where("_v is not null")
    names = F.from_json(F.get_json_object(F.to_json(F.struct("_v")), "$._v.required"), "array<string>")
    rows = doc.withColumn("_required", names).withColumn("_props", F.try_variant_get("_v", "$.properties", "variant"))
    rows = rows.lateralJoin(tools.sparkSession.tvf.variant_explode(F.col("_props").outer()))
    text = lambda path: F.try_variant_get("value", path, "string")
    bare = lambda path: F.coalesce(F.to_json(F.try_variant_get("value", path, "variant")), F.lit("{}")).isin("{}", "null", "[]")
    item = (text("$.type") == "array") & (text("$.items.type") == "object") & bare("$.items.properties")
    opaque = F.coalesce(item | ((text("$.type") == "object") & bare("$.properties")), F.lit(False))
    described = F.coalesce(text("$.description"), F.lit("")) != ""
    return rows.select(key, F.col("key").alias("param"), text("$.type").alias("type"), F.coalesce(F.array_contains("_required", F.col("key")), F.lit(False)).alias("required"), described.alias("described"), opaque.alias("opaque"))


def shapes(params: DataFrame, key: str) -> DataFrame:
    """(key, shape): the sorted types of a tool's parameters, each with whether it must be given; names don't count."""
    one = F.concat(F.coalesce("type", F.lit("None")), F.when(F.col("required"), "!").otherwise("?"))
    return params.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("shape"))


def groups(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """(by, n, least): values that two rows or more share, how many, and the least key of them; membership is a join with it."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(key).alias("least")).where("n > 1")


def prefix_families(tools: DataFrame, key: str, name: str, sizes: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """(prefix, n, least): beginnings of 2 to 4 tokens that the longer names of two tools or more share."""
    t = tools.select(key, name_tokens(F.col(name)).alias("_t"))
    starts = F.array_compact(F.array(*[F.when(F.size("_t") > k, F.array_join(F.slice("_t", 1, k), "_")) for k in sizes]))
    return groups(t.select(key, F.explode(starts).alias("prefix")), ["prefix"], key)


def referring(tools: DataFrame, key: str, description: str, words: Sequence[str] = FORBIDDEN) -> DataFrame:
    """(key, marks): descriptions that hold one of the words, and which, in the words' order."""
    low = F.lower(F.coalesce(F.col(description), F.lit("")))
    marks = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), w) for w in words]))
    return tools.select(key, marks.alias("marks")).where(F.size("marks") > 0)


def schema_gaps(params: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, params, undescribed, opaque): how many parameters there are, lack a description, or say nothing of what they hold."""
    return params.groupBy(*by).agg(F.count("*").alias("params"), F.count_if(~F.col("described")).alias("undescribed"), F.count_if("opaque").alias("opaque"))
