"""Queries of catalogues of tools: each part is a tool, with a schema whose shape depends on it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as ca
from ..operators import twins as tw
from ..views import oracle, view


def _params(spark: SparkSession, sf: str) -> DataFrame:
    return ca.parameters(view(spark, sf, "v15"), "id", "esquema")


def a24_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes of schemas that several tools share, with membership by the shape."""
    return ca.groups(ca.shapes(_params(spark, sf), "id"), ["shape"], "id")


def a24_prefix_families(spark: SparkSession, sf: str) -> DataFrame:
    return ca.prefix_families(view(spark, sf, "v15"), "id", "nombre")


def a24_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return ca.groups(view(spark, sf, "v15").select("id", F.lower(ca.summary(F.col("descripcion"))).alias("resumen")), ["resumen"], "id")


def k8_forbidden(spark: SparkSession, sf: str) -> DataFrame:
    return ca.referring(view(spark, sf, "v15"), "id", "descripcion").select("id", F.array_join("marks", ",").alias("marcas"))


def k8_schema_gaps(spark: SparkSession, sf: str) -> DataFrame:
    p = _params(spark, sf).join(view(spark, sf, "v15").select("id", "catalogo"), "id")
    return ca.schema_gaps(p, ["catalogo"])


def j8_string_twins(spark: SparkSession, sf: str) -> DataFrame:
    """Tools whose names are alike, by their smallest ids; equal names have one."""
    t = tw.string_twins(view(spark, sf, "v15"), "id", F.col("nombre"), 0.85)
    return t.select("a", "b", F.round("ratio", 6).alias("ratio"))


def j8_twin_report(spark: SparkSession, sf: str) -> DataFrame:
    p = _params(spark, sf).groupBy("id").agg(F.collect_set("param").alias("ps"))
    x = view(spark, sf, "v15").join(p, "id", "left")
    return tw.twin_report(x, "id", F.col("nombre"), ca.summary(F.col("descripcion")), F.coalesce("ps", F.array().cast("array<string>")))


QUERIES = {f.__name__: f for f in (j8_string_twins, j8_twin_report, a24_shapes, a24_prefix_families, a24_summaries, k8_forbidden, k8_schema_gaps)}

_OK = "id % 17 <> 0"
_PROPS = f"""p AS (SELECT id, catalogo, 'name' AS param, 'string' AS type, id % 3 > 0 AS required, id % 4 > 0 AS described, false AS opaque FROM v15 WHERE {_OK}
 UNION ALL SELECT id, catalogo, 'size', 'integer', false, true, false FROM v15 WHERE {_OK} AND id % 2 = 0
 UNION ALL SELECT id, catalogo, 'options', 'object', id % 3 > 0, false, id % 5 > 0 FROM v15 WHERE {_OK} AND id % 6 < 3
 UNION ALL SELECT id, catalogo, 'rows', 'array', false, true, id % 4 > 1 FROM v15 WHERE {_OK} AND id % 7 = 1
 UNION ALL SELECT id, catalogo, 'any', NULL, false, false, false FROM v15 WHERE {_OK} AND id % 10 = 3)"""
_MARKS = ", ".join(f"CASE WHEN contains(lower(descripcion), '{w}') THEN '{w}' END" for w in ca.FORBIDDEN)
_TOKENS = "t AS (SELECT id, list_filter(regexp_split_to_array(lower(nombre), '[_\\W]+'), lambda x: x <> '') AS t FROM v15)"

ORACLE = {
    "a24_shapes": oracle("v15", f", {_PROPS}, s AS (SELECT id, string_agg(coalesce(type, 'None') || CASE WHEN required THEN '!' ELSE '?' END, ',' ORDER BY coalesce(type, 'None') || CASE WHEN required THEN '!' ELSE '?' END) AS shape FROM p GROUP BY id) SELECT shape, count(*) AS n, min(id) AS least FROM s GROUP BY shape HAVING count(*) > 1"),
    "a24_prefix_families": oracle("v15", f", {_TOKENS}, x AS (SELECT id, array_to_string(t[1:k], '_') AS prefix FROM t, range(2, 5) r(k) WHERE len(t) > k) SELECT prefix, count(*) AS n, min(id) AS least FROM x GROUP BY prefix HAVING count(*) > 1"),
    "a24_summaries": oracle("v15", ", s AS (SELECT id, lower(trim(regexp_replace(split_part(replace(descripcion, chr(10), ' '), ' Args:', 1), '[ \\t]+', ' ', 'g'))) AS resumen FROM v15) SELECT resumen, count(*) AS n, min(id) AS least FROM s GROUP BY resumen HAVING count(*) > 1"),
    "k8_forbidden": oracle("v15", f", m AS (SELECT id, array_to_string(list_filter([{_MARKS}], lambda x: x IS NOT NULL), ',') AS marcas FROM v15) SELECT * FROM m WHERE marcas <> ''"),
    "k8_schema_gaps": oracle("v15", f", {_PROPS} SELECT catalogo, count(*) AS params, count(*) FILTER (NOT described) AS undescribed, count(*) FILTER (opaque) AS opaque FROM p GROUP BY catalogo"),
}
