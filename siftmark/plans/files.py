"""Queries of sources and sinks: each writes a folder of files from the tables, and reads it as a user's folder would be read."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signatures as sg
from ..shared import cut, new_shared_path, remove
from ..sources import files
from ..views import oracle, table, view

PAGES = 200  # of a file


def _pages_folder(spark: SparkSession, sf: str) -> str:
    """A folder with a file for every 200 pages, a page a line, in folders of their own; and a file without a byte."""
    path = new_shared_path(spark, "pages")
    pages = table(spark, sf, "pages").select(F.floor(F.col("page_id") / PAGES).alias("grupo"), "page_id", "html")
    pages.repartition("grupo").sortWithinPartitions("grupo", "page_id").select("grupo", "html").write.partitionBy("grupo").text(path)
    spark.createDataFrame([], "value string").coalesce(1).write.text(f"{path}/grupo=vacio")
    return path


def _read(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """df, read, and the folder that it was read from removed."""
    df = cut(df)
    remove(spark, path)
    return df


def _group():
    return F.regexp_extract("path", "grupo=([^/]*)/", 1).alias("grupo")


def s1_inventory(spark: SparkSession, sf: str) -> DataFrame:
    path = _pages_folder(spark, sf)
    found = files.inventory(spark, path)
    reach = spark.createDataFrame([("txt", "pdf"), ("pdf", "png")], "origen string, destino string")
    able = files.candidates(found, reach, "pdf")
    return _read(spark, path, able.select(_group(), "ext", "size", (F.col("size") == 0).alias("vacio")))


def s2_census(spark: SparkSession, sf: str) -> DataFrame:
    path = _pages_folder(spark, sf)
    by_dir = files.census(spark, path).groupBy(F.regexp_extract("dir", "([^/]*)$", 1).alias("dir")).agg(F.count("*").alias("ficheros"), F.sum("size").alias("bytes"))
    return _read(spark, path, by_dir)


def s3_headers(spark: SparkSession, sf: str) -> DataFrame:
    """The first bytes and the last of each file of at least one byte, and what they show."""
    path = _pages_folder(spark, sf)
    found = files.headers(spark, path, tail=8).where("size > 0")
    return _read(spark, path, found.select(_group(), "size", F.hex(F.substring("head", 1, 100)).alias("inicio"), F.length("head").alias("leidos"), F.hex("tail").alias("final"), sg.signature(F.col("head"), F.col("size")).alias("tipo")))


def s4_texts(spark: SparkSession, sf: str) -> DataFrame:
    path = _pages_folder(spark, sf)
    return _read(spark, path, files.texts(spark, path).where("size > 0").select(_group(), F.length("text").alias("caracteres"), F.md5("text").alias("md5")))


def s5_probes(spark: SparkSession, sf: str) -> DataFrame:
    """A document of each engine, that is nation, with its edges; one document is cut off and left out."""
    path = new_shared_path(spark, "probes")
    edges = view(spark, sf, "v4_edges").groupBy("origen").agg(F.sort_array(F.collect_list(F.struct(F.col("origen").cast("string").alias("origen"), F.col("destino").cast("string").alias("destino"), "estado", F.col("coste").cast("double").alias("ms")))).alias("aristas"))
    docs = edges.select(F.concat(F.lit("m"), "origen").alias("motor"), F.concat(F.lit("b"), F.col("origen") % 3).alias("build"), F.create_map(F.lit("bin"), F.col("origen").cast("string")).alias("huella"), "aristas")
    text = F.to_json(F.struct("motor", "build", "huella", "aristas"))
    docs.select("motor", F.when(F.col("motor") == "m7", F.substring(text, 1, 40)).otherwise(text).alias("value")).repartition("motor").write.partitionBy("motor").text(path)
    found = files.probes(spark, path)
    return _read(spark, path, found.select("motor", "build", F.col("huella")["bin"].alias("bin"), F.size("aristas").alias("aristas"), F.aggregate("aristas", F.lit(0.0), lambda s, x: s + x["ms"]).alias("ms")))


def s6_run_log(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "runs")
    v = view(spark, sf, "v9").groupBy("user_id", "dia", "catalogo", "estrato").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "herramienta"))).alias("h"), F.sum("coste").alias("coste"), F.count_if(F.col("herramienta") == "error").alias("errores"))
    runs = v.select(F.concat(F.lit("c"), "catalogo").alias("catalogo"), F.concat_ws("/", "user_id", "dia").alias("tarea"), "estrato", F.col("h.herramienta").alias("herramientas"), F.round("coste", 4).alias("coste_usd"), (F.col("errores") > 1).cast("int").alias("rc"))
    files.write_json_lines(runs, path)
    return _read(spark, path, files.run_log(spark, path).groupBy("catalogo", "estrato").agg(F.count("*").alias("corridas"), F.sum(F.size("herramientas")).alias("llamadas"), F.round(F.sum("coste_usd"), 2).alias("coste")))


def s8_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows written as JSON lines, and the table made of them."""
    path = new_shared_path(spark, "scored")
    files.write_json_lines(view(spark, sf, "v3").select("destino", F.concat(F.lit("l"), "l_linenumber").alias("linea"), "obtenido_bps"), path)
    rows = spark.read.schema("destino string, linea string, obtenido_bps double").json(path)
    return _read(spark, path, files.pivot(rows, "destino", "linea", "obtenido_bps", [f"l{i}" for i in range(1, 8)]))


QUERIES = {f.__name__: f for f in (s1_inventory, s2_census, s3_headers, s4_texts, s5_probes, s6_run_log, s8_pivot)}

_G = f"g AS (SELECT CAST(page_id // {PAGES} AS VARCHAR) AS grupo, string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id) AS t FROM pages GROUP BY 1), h AS (SELECT *, hex(encode(t)) AS h FROM g)"
_DOCTYPE = "'<!doctype html'"

ORACLE = {
    "s1_inventory": f"WITH {_G} SELECT grupo, 'txt' AS ext, strlen(t) AS size, false AS vacio FROM g UNION ALL SELECT 'vacio', 'txt', 0, true",
    "s2_census": f"WITH {_G} SELECT 'grupo=' || grupo AS dir, 1 AS ficheros, strlen(t) AS bytes FROM g UNION ALL SELECT 'grupo=vacio', 1, 0",
    "s3_headers": f"""WITH {_G} SELECT grupo, strlen(t) AS size, substr(h, 1, 200) AS inicio, CAST(least(2056, strlen(t)) AS INTEGER) AS leidos, right(h, 16) AS final,
 CASE WHEN starts_with(lower(ltrim(t)), {_DOCTYPE}) OR starts_with(lower(ltrim(t)), '<html') THEN 'html' ELSE 'texto' END AS tipo FROM h""",
    "s4_texts": f"WITH {_G} SELECT grupo, length(t) AS caracteres, md5(t) AS md5 FROM g",
    "s5_probes": oracle("v4_edges", "SELECT 'm' || origen AS motor, 'b' || origen % 3 AS build, CAST(origen AS VARCHAR) AS bin, CAST(count(*) AS INTEGER) AS aristas, CAST(sum(coste) AS DOUBLE) AS ms FROM v4_edges WHERE origen <> 7 GROUP BY origen"),
    "s6_run_log": oracle("v9", ", r AS (SELECT user_id, dia, catalogo, estrato, count(*) AS n, round(sum(coste), 4) AS coste, count(*) FILTER (herramienta = 'error') AS errores FROM v9 GROUP BY ALL) SELECT 'c' || catalogo AS catalogo, estrato, count(*) AS corridas, CAST(sum(n) AS BIGINT) AS llamadas, round(sum(coste), 2) AS coste FROM r WHERE errores <= 1 GROUP BY catalogo, estrato"),
    "s8_pivot": oracle("v3", "SELECT destino, " + ", ".join(f"round(avg(obtenido_bps) FILTER (l_linenumber = {i}), 6) AS l{i}" for i in range(1, 8)) + " FROM v3 GROUP BY destino"),
}
