"""Queries of upkeep: references, binaries, headings, logs, contracts, counters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrivals as ar
from ..operators import upkeep as up
from ..shared import cut, new_shared_path, remove
from ..sources import files
from ..views import oracle, table, view
from .corpus import _STABLE, _stable

PAGES = 500  # of a file
NODES = [("grafo:", "grafo"), ("sidecar", "motor"), ("permission", "sistema"), ("[en]", "entrada"), ("[de]", "salida")]
CAUSES = ["no such file", "Permission denied", "timed out"]


def k6_large_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages are written 500 to a file, every other file with a NUL in front; files of one folder are evidence, and allowed."""
    path = new_shared_path(spark, "binaries")
    g = F.floor(F.col("page_id") / PAGES)
    first = (F.col("page_id") % PAGES == 0) & (g % 2 == 0)
    pages = table(spark, sf, "pages").select(g.alias("grupo"), "page_id", F.concat(F.when(first, F.lit("\0")).otherwise(""), F.coalesce("html", F.lit(""))).alias("value"))
    pages.repartition("grupo").sortWithinPartitions("grupo", "page_id").select("grupo", "value").write.partitionBy("grupo").text(path)
    found = files.headers(spark, path, n=up.WINDOW).withColumn("path", F.regexp_extract("path", "(grupo=.*)$", 1))
    out = cut(up.large_binaries(found, ["grupo=4/"]).select(F.regexp_extract("path", "grupo=([^/]*)/", 1).alias("grupo"), "size"))
    remove(spark, path)
    return out


_NOTE = "CASE WHEN doc_id % 3 = 0 THEN concat('### ', lang, CASE WHEN doc_id % 2 = 0 THEN ' (En Curso)' ELSE ' (cerrado)' END, chr(10), text) ELSE concat(text, chr(10), '# en curso', chr(10), '##### en curso', chr(10), '## hecho, no EN CURSO') END"
_LOG = "concat('[', lang, '] step ', source, chr(10), CASE doc_id % 5 WHEN 0 THEN 'open: No such file' WHEN 1 THEN 'open: permission denied' WHEN 2 THEN 'ok' ELSE concat('sidecar', chr(10), 'x TIMED OUT after 5 s') END, chr(10), CASE WHEN doc_id % 7 = 0 THEN 'grafo: no such file' ELSE '' END)"


def k7_open_headings(spark: SparkSession, sf: str) -> DataFrame:
    notes = table(spark, sf, "documents").select("doc_id", F.expr(_NOTE).alias("nota"))
    return up.matching_lines(notes, "doc_id", "nota")


def k9_triage(spark: SparkSession, sf: str) -> DataFrame:
    logs = table(spark, sf, "documents").select("doc_id", F.expr(_LOG).alias("log"))
    return up.triage(logs, "doc_id", "log", NODES, CAUSES)


def k1_references(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages that no page of even id has, but those that the benchmark's items name as foreign."""
    p = table(spark, sf, "pages")
    known = p.where("page_id % 2 = 0").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("ref"))
    return up.dead_references(p, "page_id", "html", 'href="/([^"]*)"', known, "ref", ["The", "and", "of"])


def u2_capability_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of a format are what its suppliers show, what it can hold is what its customers have."""
    props = lambda x, k, n: x.where(F.col(k) % 3 > 0).groupBy(F.col(n)).agg(F.collect_set(F.concat(F.lit("p"), (F.col(k) % 7).cast("string"))).alias("props"))
    measured = props(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey").withColumnRenamed("s_nationkey", "origen")
    holds = props(table(spark, sf, "customer").where("c_custkey % 11 < 2"), "c_custkey", "c_nationkey").withColumnRenamed("c_nationkey", "destino")
    asked = view(spark, sf, "v4_edges").select("origen", "destino")
    return up.capability_contract(asked, measured, holds).select("origen", "destino", *[F.array_join(c, ",").alias(c) for c in ("contrato", "perdidas")])


def a28_arrival_counters(spark: SparkSession, sf: str) -> DataFrame:
    runs = ar.with_patience(_stable(spark, sf, 2), F.col("tamano") % 3 == 0, 2, 3)
    there = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("ruta"), F.lit(True).alias("existe")).distinct()
    return up.counters(runs.join(there, "ruta", "left"), "estado", F.coalesce("existe", F.lit(False)), "n", 2)


def a23_first_choices(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v9")
    runs = v.groupBy("user_id", "dia", "catalogo").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "herramienta"))), lambda s: s["herramienta"]).alias("h"), F.sum("coste").alias("coste"), (F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts"))).alias("s"))
    return up.first_choices(runs, "catalogo", "h", "coste", "s")


QUERIES = {f.__name__: f for f in (k1_references, k6_large_files, k7_open_headings, k9_triage, u2_capability_contract, a28_arrival_counters, a23_first_choices)}

_NODE = " ".join(f"WHEN contains(lower(log), '{n.lower()}') THEN '{v}'" for n, v in NODES)
_CAUSE = " OR ".join(f"contains(lower(x), '{c.lower()}')" for c in CAUSES)

ORACLE = {
    "k1_references": """WITH r AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS ref FROM pages) SELECT page_id, ref FROM r WHERE ref NOT IN ('The', 'and', 'of') AND ref NOT IN (SELECT ref FROM r WHERE page_id % 2 = 0)""",
    "k6_large_files": f"WITH g AS (SELECT page_id // {PAGES} AS g, sum(strlen(coalesce(html, '')) + 1) + CASE WHEN page_id // {PAGES} % 2 = 0 AND bool_or(page_id % {PAGES} = 0) THEN 1 ELSE 0 END AS size, bool_or(page_id % {PAGES} = 0) AS nul FROM pages GROUP BY 1) SELECT CAST(g AS VARCHAR) AS grupo, CAST(size AS BIGINT) AS size FROM g WHERE g % 2 = 0 AND nul AND size > {up.LARGE} AND g <> 4",
    "k7_open_headings": f"WITH n AS (SELECT doc_id, string_split({_NOTE}, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS line FROM n) SELECT doc_id, CAST(line AS INTEGER) AS line, substr(c, 1, 80) AS content FROM x WHERE regexp_matches(c, '(?i)^#{{2,4}} .*(en curso)')",
    "k9_triage": f"WITH d AS (SELECT doc_id, {_LOG} AS log FROM documents), s AS (SELECT doc_id, log, string_split(log, chr(10)) AS l FROM d), x AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM s), c AS (SELECT doc_id, min(k) AS line, arg_min(substr(trim(x), 1, 160), k) AS cause FROM x WHERE {_CAUSE} GROUP BY doc_id) SELECT s.doc_id, CASE {_NODE} ELSE 'otro' END AS node, CAST(c.line AS INTEGER) AS line, c.cause FROM s LEFT JOIN c ON c.doc_id = s.doc_id",
    "u2_capability_contract": oracle("v4_edges", """, m AS (SELECT s_nationkey AS f, list_distinct(list('p' || s_suppkey % 7)) AS p FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY 1), h AS (SELECT c_nationkey AS f, list_distinct(list('p' || c_custkey % 7)) AS p FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 11 < 2 GROUP BY 1)
SELECT origen, destino, array_to_string(list_sort(list_filter(coalesce(m.p, []), lambda x: list_contains(coalesce(h.p, []), x))), ',') AS contrato, array_to_string(list_sort(list_filter(coalesce(m.p, []), lambda x: NOT list_contains(coalesce(h.p, []), x))), ',') AS perdidas FROM v4_edges LEFT JOIN m ON m.f = origen LEFT JOIN h ON h.f = destino"""),
    "a28_arrival_counters": f"""WITH {_STABLE.format(polls=2)}, t AS (SELECT n, ruta IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS existe, CASE WHEN n < 2 THEN 'pendiente' WHEN tamano % 3 <> 0 THEN 'servido' WHEN n >= 5 THEN 'desistido' ELSE 'pospuesto' END AS estado FROM s)
SELECT CAST(sum(n) AS BIGINT) AS vistos, count(*) FILTER (n >= 2) AS maduros, count(*) FILTER (estado IN ('servido', 'desistido') AND NOT existe) AS atendidos, count(*) FILTER (estado IN ('servido', 'desistido') AND existe) AS saltados, count(*) FILTER (estado = 'pospuesto') AS aplazados, count(*) FILTER (estado = 'desistido') AS rendidos FROM t""",
    "a23_first_choices": oracle("v9", """, r AS (SELECT user_id, dia, catalogo, list(herramienta ORDER BY ts, event_id) AS h, sum(coste) AS coste, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS s FROM v9 GROUP BY ALL),
 m AS (SELECT catalogo, count(*) AS runs, round(avg(len(h)), 5) AS calls, round(avg(coste), 5) AS cost, round(avg(s), 5) AS seconds FROM r GROUP BY 1), c AS (SELECT catalogo, h[1] AS tool, count(*) AS chosen FROM r GROUP BY 1, 2)
SELECT m.*, tool, chosen, CAST(row_number() OVER (PARTITION BY c.catalogo ORDER BY chosen DESC, tool) AS INTEGER) AS rank FROM m JOIN c ON c.catalogo = m.catalogo"""),
}
