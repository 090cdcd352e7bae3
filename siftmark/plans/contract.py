"""Queries of the verification contract over probe pairs, tabular pairs, directory listings and job events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import media, text
from ..functions import signatures as sg
from ..operators import contract as ct
from ..views import oracle, table, view

K3 = ["l_orderkey", "l_linenumber"]


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v3")
    v = v.withColumn("alfa_min", F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey") % 5 * 64)).withColumn("alfa_sal", F.col("l_partkey") % 3 == 0)
    return v.withColumn("esperadas", F.when(F.col("l_linenumber") < 6, F.col("pistas_ent")))


def _tolerance():
    return media.duration_tolerance(F.array(F.struct(F.col("destino").alias("codec"), F.col("sr_sal").alias("sample_rate"))), F.col("categoria") == "av")


def _rules() -> list[ct.Rule]:
    wide = F.col("ancho_ent")
    return [
        ct.track_count("esperadas", "pistas_sal"),
        ct.differ("I1/V7", 4, "ancho_ent", "ancho_sal", "resized without being asked"),
        ct.aspect(wide, F.lit(100), F.col("ancho_sal"), F.lit(100)),
        ct.depth("prof_ent", "prof_sal", "destino"),
        ct.alpha("alfa_min", "alfa_sal", "destino"),
        ct.duration("dur_ent", "dur_sal", _tolerance()),
        ct.sample_rate("sr_ent", "sr_sal", "destino"),
        ct.video_rate("pedido_bps", "obtenido_bps", "n_audio"),
        ct.audio_rate("pedido_bps", "obtenido_bps"),
        ct.Rule("P1", 4, F.when((F.col("categoria") == "pdf") & (F.col("pistas_ent") != F.col("pistas_sal")), ct.FAIL), F.col("pistas_ent"), F.col("pistas_sal"), "page count changed"),
    ]


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return ct.findings(_pairs(spark, sf), K3, _rules())


def c4_c17_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf).select(*K3, "seq", "point", "rule", "severity")


def c1_return_and_size(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v3").withColumn("bytes", F.when(F.col("l_partkey") % 13 > 0, F.col("l_partkey") % 11)).withColumn("rc", F.col("l_partkey") % 7)
    size, rc = F.col("bytes"), F.col("rc")
    rules = [ct.Rule("G1-missing", 1, F.when(size.isNull(), ct.FAIL), F.lit(1), size, "no output"), ct.Rule("G1-empty", 1, F.when(size == 0, ct.FAIL), F.lit(1), size, "empty output"), ct.Rule("G1-rc", 1, F.when(rc != 0, ct.FAIL), F.lit(0), rc, "engine failed")]
    return ct.findings(v, K3, rules).select(*K3, "rule", "severity")


def c2_c3_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Real type against extension, and whether an unknown extension's output kept the input's type."""
    v = view(spark, sf, "v1").withColumn("ext", fm.normal_extension(fm.extension(F.col("name")))).withColumn("tipo", sg.text_type(F.col("body")))
    v = v.withColumn("tipo_ent", F.when(F.length("body") % 2 == 0, F.col("tipo")).otherwise("pdf"))
    status, fits = fm.signature_status(F.col("ext")), fm.coherent(F.col("tipo"), F.col("ext"))
    rules = [
        ct.Rule("G3", 1, F.when(status == "sin_vocabulario", ct.INFO).when(fits.isNotNull() & ~fits, ct.FAIL), F.col("ext"), F.col("tipo"), "type and extension"),
        ct.Rule("G4", 1, F.when(status == "no_aplica", ct.INFO), F.col("ext"), F.col("tipo"), "format without marker"),
        ct.Rule("G5", 1, F.when(status == "familia", ct.INFO), F.col("ext"), F.col("tipo"), "family only"),
        ct.Rule("G6", 1, F.when(fits.isNull() & (F.col("tipo") == F.col("tipo_ent")) & (F.col("tipo") != "texto"), ct.WARN), F.col("ext"), F.col("tipo"), "same type as the input"),
    ]
    return ct.findings(v, ["name"], rules).select("name", "rule", "severity")


def c5_c7_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Point 3: dimensions, depth, durations, channels, rates and pages that an output of its kind must have."""
    v = view(spark, sf, "v3").withColumn("w", F.when(F.col("l_partkey") % 17 > 0, F.col("l_partkey") % 9)).withColumn("prof", F.col("l_partkey") % 20).withColumn("dur", F.when(F.col("l_partkey") % 19 > 0, F.col("l_partkey") % 6)).withColumn("sr", F.col("l_partkey") * 10).withColumn("canales", F.when(F.col("l_partkey") % 5 > 0, 2)).withColumn("paginas", F.col("l_partkey") % 8).withColumn("comprimido", F.col("l_partkey") % 3 == 0)
    c, of = F.col, lambda k: F.col("categoria") == k
    rules = [
        ct.Rule("I1", 3, F.when(of("imagen"), F.when(c("w").isNull(), ct.FAIL).when(c("w") < 2, ct.WARN)), F.lit(2), c("w"), "dimensions"),
        ct.Rule("I5", 3, F.when(of("imagen") & ~c("prof").isin(*ct.DEPTHS), ct.WARN), F.lit(None), c("prof"), "odd depth"),
        ct.Rule("A1", 3, F.when(of("av") & (c("dur").isNull() | (c("dur") <= 0)), ct.FAIL), F.lit(None), c("dur"), "duration"),
        ct.Rule("A2", 3, F.when(of("av") & c("canales").isNull(), ct.WARN), F.lit(None), c("canales"), "channels"),
        ct.Rule("A3", 3, F.when(of("av") & ~c("sr").between(8000, 192000), ct.WARN), F.lit(None), c("sr"), "sample rate"),
        ct.Rule("P1", 3, F.when(of("pdf") & (c("paginas") == 0), F.when(c("comprimido"), ct.WARN).otherwise(ct.FAIL)), F.lit(1), c("paginas"), "pages"),
    ]
    return ct.findings(v, K3, rules).select(*K3, "rule", "severity")


def c10_density(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v3").where("categoria = 'pdf'").withColumn("dpi", F.lit(144)).withColumn("dpi_sal", 142 + F.col("l_partkey") % 5).withColumn("pt", F.col("ancho_ent") / 2.0)
    c = F.col
    rules = [
        ct.Rule("P4-dpi", 4, F.when(F.abs(c("dpi") - c("dpi_sal")) > 1, ct.FAIL), c("dpi"), c("dpi_sal"), "density"),
        ct.Rule("P4-px", 4, F.when(F.abs(c("pt") * c("dpi") / 72 - c("ancho_sal")) > 0.5, ct.FAIL), c("pt"), c("ancho_sal"), "pixels for points"),
        ct.Rule("P7", 4, F.when((c("ancho_sal") > 900) & (c("l_partkey") % 2 == 0), ct.WARN), c("pt"), c("ancho_sal"), "one pixel a point"),
    ]
    return ct.findings(v, K3, rules).select(*K3, "rule", "severity")


def _tabular() -> list[ct.Rule]:
    c = F.col
    header = lambda x: F.array_sort(F.split(x, ","))
    measured = ~c("sin_sonda_ent")
    return [
        ct.Rule("D5", 3, F.when(c("ufffd"), ct.FAIL), F.lit(False), c("ufffd"), "replacement characters"),
        ct.Rule("D2", 3, F.when(c("anchos_distintos") > 1, ct.FAIL), F.lit(1), c("anchos_distintos"), "field count varies"),
        ct.Rule("D1", 4, F.when(measured & (c("filas_ent") != c("filas_sal")), ct.FAIL), c("filas_ent"), c("filas_sal"), "row count changed"),
        ct.Rule("D1-header", 4, F.when(measured & (header(c("cab_ent")) != header(c("cab_sal"))), ct.FAIL), c("cab_ent"), c("cab_sal"), "header changed"),
        ct.Rule("D4", 4, F.when(c("bom"), ct.WARN), F.lit(False), c("bom"), "byte order mark"),
    ]



def c8_c18_tabular(spark: SparkSession, sf: str) -> DataFrame:
    return ct.findings(view(spark, sf, "v2"), ["job"], _tabular()).select("job", "rule", "severity", "expected", "obtained")


def c23_tabular_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return ct.verdicts(view(spark, sf, "v2"), _tabular(), ["job"], ~F.col("sin_sonda_ent"))


def _covered():
    return F.col("esperadas").isNotNull() & F.col("alfa_min").isNotNull()


def _media_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return ct.verdicts(_pairs(spark, sf), _rules(), K3, _covered())


def c23_media_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _media_verdict(spark, sf)


def _points() -> dict:
    c = F.col
    return {"1_firma": F.lit(True), "2_flujos": c("esperadas").isNotNull(), "3_integridad": c("categoria").isNotNull(), "4_pedido": c("alfa_min").isNotNull(), "5_escritura": c("n_audio") > 0, "6_cadena": c("l_linenumber") > 1}


def c22_c27_coverage(spark: SparkSession, sf: str) -> DataFrame:
    cover = ct.coverage(_points())
    return _pairs(spark, sf).select(*K3, F.array_join(F.array_sort(F.map_keys(F.map_filter(cover, lambda _, v: v))), ",").alias("cubiertos"), ct.coverage_ratio(cover).alias("ratio"))


def c24_chain(spark: SparkSession, sf: str) -> DataFrame:
    return ct.chain(_media_verdict(spark, sf), "l_orderkey", "l_linenumber", "verdict")


def c25_short(spark: SparkSession, sf: str) -> DataFrame:
    return ct.short(_pairs(spark, sf), _rules(), K3)


def c26_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ct.summary(_pairs(spark, sf), _rules(), K3, _covered())


def _census(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v11")
    half = lambda p: v.where(F.col("fase") == p).drop("fase")
    return ct.census(half("antes"), half("despues"), ["job", "dir", "nombre"])


def j3_census(spark: SparkSession, sf: str) -> DataFrame:
    return _census(spark, sf)


_FILE = """CASE nombre % 4 WHEN 0 THEN concat('f', lpad(CAST(nombre % 1000 AS VARCHAR(10)), 3, '0'), '.png') WHEN 1 THEN concat('hoja', CAST(nombre % 100 AS VARCHAR(10)), '.svg')
 WHEN 2 THEN concat('seg', CAST(nombre AS VARCHAR(20)), '.m4s') ELSE CASE WHEN nombre % 3 = 0 THEN concat('salida', CAST(nombre AS VARCHAR(20)), '.log') ELSE concat('nota', CAST(nombre AS VARCHAR(20)), '.txt') END END"""
_DECLARED = "CASE job % 5 WHEN 0 THEN 'f%03d.png' WHEN 1 THEN 'f%d.png' WHEN 2 THEN 'hoja%02i.svg' WHEN 3 THEN 'salida.mpd' ELSE 'f(1).[x]%d+.png' END"
_TARGET = "CASE job % 5 WHEN 2 THEN 'svg' WHEN 3 THEN 'mpd' ELSE 'png' END"


def c19_c21_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Files get names by their numbers; jobs declare printf patterns, or a manifest that comes with segments."""
    c = _census(spark, sf).withColumn("fichero", F.expr(_FILE)).withColumn("declarado", F.expr(_DECLARED))
    name, said = F.col("fichero"), F.col("declarado")
    return ct.writes(c, "job", F.col("nombre") % 5 != 0, ct.is_declared(name, said), ct.is_satellite(name, said), ct.comes_in_several(F.expr(_TARGET), said))


def c20_numbered_outputs(spark: SparkSession, sf: str) -> DataFrame:
    c = _census(spark, sf).where("estado = 'nuevo'").select("job", F.expr(_FILE).alias("fichero"))
    said = view(spark, sf, "v11").select("job").distinct().withColumn("declarado", F.expr(_DECLARED))
    return ct.numbered_outputs(c, said, ["job"], "fichero", "declarado")


def c8_data_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Each part is written as JSON or as CSV, some cut off, in another encoding, or with a mark before; facts come from the bytes."""
    k = F.col("p_partkey")
    kind = F.when(k % 2 == 0, "json").otherwise("csv")
    whole = F.when(k % 2 == 0, F.to_json(F.struct("p_partkey", "p_name"))).otherwise(F.concat_ws("\n", F.lit("clave,nombre"), F.concat_ws(",", k, "p_name"), F.when(k % 11 == 0, F.lit("1,2,3")), F.lit("")))
    body = F.when(k % 9 == 0, F.expr("left(todo, length(todo) - 1)")).otherwise(F.col("todo"))
    body = F.when(k % 5 == 0, F.concat(body, F.lit("\uFFFD"))).otherwise(body).cast("binary")
    mark, tail = F.when(k % 7 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.lit(b"")), F.when(k % 13 == 0, F.unhex(F.lit("0AFF"))).otherwise(F.lit(b""))
    x = table(spark, sf, "part").withColumn("todo", whole).select(k, kind.alias("formato"), F.concat(mark, body, tail).alias("c"))
    x = x.withColumn("hechos", text.data_facts(F.col("c"), F.col("formato")))
    return ct.findings(x, ["p_partkey"], ct.data_rules("hechos")).select("p_partkey", "rule", "severity")


def c28_leftovers(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v11")
    after, declared = v.where("fase = 'despues'"), v.where("fase = 'antes'").select("job", "dir", "nombre")
    return after.join(declared, ["job", "dir", "nombre"], "left_anti").groupBy("job").agg(F.count("*").alias("n"), F.sum("tam").alias("bytes"))


def c29_batch(spark: SparkSession, sf: str) -> DataFrame:
    out = ct.batch(view(spark, sf, "v12"), "job", "estado", "event_id", F.struct("ts", "event_id"))
    return out.withColumn("outputs", F.array_join(F.transform("outputs", lambda x: x.cast("string")), ","))


QUERIES = {f.__name__: f for f in (c1_return_and_size, c2_c3_signatures, c4_c17_findings, c5_c7_integrity, c8_c18_tabular, c8_data_rules, c10_density, c19_c21_writes, c20_numbered_outputs, c22_c27_coverage, c23_tabular_verdict, c23_media_verdict, c24_chain, c25_short, c26_summary, c28_leftovers, c29_batch, j3_census)}

_PAIRS = """p AS (SELECT *, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 5 * 64 END AS alfa_min, l_partkey % 3 = 0 AS alfa_sal, CASE WHEN l_linenumber < 6 THEN pistas_ent END AS esperadas FROM v3),
 r AS (SELECT *, (obtenido_bps - pedido_bps) / pedido_bps AS drift FROM p),
 f AS (
  SELECT l_orderkey, l_linenumber, 0 AS seq, 2 AS point, 'V3' AS rule, 'tracks expected and obtained' AS message, CASE WHEN esperadas IS NULL THEN 'informativo' WHEN pistas_sal < esperadas THEN 'fallo' WHEN pistas_sal > esperadas THEN 'aviso' END AS severity FROM r
  UNION ALL SELECT l_orderkey, l_linenumber, 1, 4, 'I1/V7', 'resized without being asked', CASE WHEN ancho_ent <> ancho_sal THEN 'fallo' END FROM r
  UNION ALL SELECT l_orderkey, l_linenumber, 2, 4, 'aspect', 'aspect ratio moved', CASE WHEN abs(ancho_ent / 100 - ancho_sal / 100) > 0.02 THEN 'aviso' END FROM r
  UNION ALL SELECT l_orderkey, l_linenumber, 3, 4, 'I5', 'depth fell', CASE WHEN prof_sal < prof_ent THEN CASE WHEN destino = 'jpg' THEN 'informativo' ELSE 'fallo' END END FROM r
  UNION ALL SELECT l_orderkey, l_linenumber, 4, 4, 'I2', 'alpha lost', CASE WHEN alfa_sal THEN NULL WHEN alfa_min IS NULL THEN 'informativo' WHEN alfa_min < 255 THEN CASE WHEN destino = 'jpg' THEN 'informativo' ELSE 'fallo' END END FROM r
  UNION ALL SELECT l_orderkey, l_linenumber, 5, 4, 'A1/V1', 'duration drift', CASE WHEN abs(dur_sal - dur_ent) > greatest(0.010::DOUBLE, CASE WHEN destino = 'opus' THEN 960::DOUBLE / sr_sal ELSE 0 END, CASE WHEN categoria = 'av' THEN 0.050::DOUBLE ELSE 0 END) THEN 'fallo' END FROM r
  UNION ALL SELECT l_orderkey, l_linenumber, 6, 4, 'A3', 'sample rate changed', CASE WHEN sr_ent <> sr_sal AND NOT (destino = 'opus' AND sr_sal = 48000) THEN 'fallo' END FROM r
  UNION ALL SELECT l_orderkey, l_linenumber, 7, 4, 'V10', 'video bit rate', CASE WHEN drift < -0.60::DOUBLE THEN 'fallo' WHEN drift > 0.60::DOUBLE THEN CASE WHEN n_audio = 0 THEN 'fallo' ELSE 'informativo' END END FROM r
  UNION ALL SELECT l_orderkey, l_linenumber, 8, 4, 'A-rate', 'audio bit rate', CASE WHEN abs(drift) > 0.50::DOUBLE THEN 'fallo' WHEN abs(drift) > 0.15::DOUBLE THEN 'aviso' END FROM r
  UNION ALL SELECT l_orderkey, l_linenumber, 9, 4, 'P1', 'page count changed', CASE WHEN categoria = 'pdf' AND pistas_ent <> pistas_sal THEN 'fallo' END FROM r),
 found AS (SELECT * FROM f WHERE severity IS NOT NULL),
 w AS (SELECT l_orderkey, l_linenumber, max(CASE severity WHEN 'fallo' THEN 2 WHEN 'aviso' THEN 1 ELSE 0 END) AS worst FROM found GROUP BY ALL),
 verdict AS (SELECT p.l_orderkey, p.l_linenumber, CASE WHEN worst = 2 THEN 'fallo' WHEN worst = 1 THEN 'aviso' WHEN esperadas IS NOT NULL AND alfa_min IS NOT NULL THEN 'ok' ELSE 'ok_parcial' END AS verdict
  FROM p LEFT JOIN w ON p.l_orderkey = w.l_orderkey AND p.l_linenumber = w.l_linenumber)
"""
_CENSUS = """a AS (SELECT * FROM v11 WHERE fase = 'antes'), d AS (SELECT * FROM v11 WHERE fase = 'despues'),
 census AS (SELECT coalesce(a.job, d.job) AS job, coalesce(a.dir, d.dir) AS dir, coalesce(a.nombre, d.nombre) AS nombre, a.tam AS antes, d.tam AS despues,
  CASE WHEN a.tam IS NULL THEN 'nuevo' WHEN d.tam IS NULL THEN 'perdido' WHEN a.tam <> d.tam THEN 'cambiado' ELSE 'igual' END AS estado FROM a FULL JOIN d ON a.job = d.job AND a.dir = d.dir AND a.nombre = d.nombre)
"""
_TAB = """f AS (SELECT job, 'D5' AS rule, 'fallo' AS severity, 'false' AS expected, 'true' AS obtained FROM v2 WHERE ufffd
  UNION ALL SELECT job, 'D2', 'fallo', '1', CAST(anchos_distintos AS VARCHAR) FROM v2 WHERE anchos_distintos > 1
  UNION ALL SELECT job, 'D1', 'fallo', CAST(filas_ent AS VARCHAR), CAST(filas_sal AS VARCHAR) FROM v2 WHERE NOT sin_sonda_ent AND filas_ent <> filas_sal
  UNION ALL SELECT job, 'D1-header', 'fallo', cab_ent, cab_sal FROM v2 WHERE NOT sin_sonda_ent AND cab_ent <> cab_sal
  UNION ALL SELECT job, 'D4', 'aviso', 'false', 'true' FROM v2 WHERE bom)
"""
from .scalars import _B, _NEXT, _TYPE  # noqa: E402

ORACLE = {
    "c1_return_and_size": oracle("v3", """SELECT l_orderkey, l_linenumber, 'G1-missing' AS rule, 'fallo' AS severity FROM v3 WHERE l_partkey % 13 = 0
UNION ALL SELECT l_orderkey, l_linenumber, 'G1-empty', 'fallo' FROM v3 WHERE l_partkey % 13 > 0 AND l_partkey % 11 = 0 UNION ALL SELECT l_orderkey, l_linenumber, 'G1-rc', 'fallo' FROM v3 WHERE l_partkey % 7 <> 0"""),
    "c2_c3_signatures": oracle("v1", f""", x AS (SELECT name, {_NEXT} AS ext, {_TYPE} AS tipo, len FROM (SELECT b.name, b.b, length(v1.body) AS len FROM {_B} b JOIN v1 ON b.name = v1.name))
SELECT name, 'G3' AS rule, 'fallo' AS severity FROM x WHERE ext = 'html' AND tipo NOT IN ('html', 'xml', 'texto') OR ext IN ('txt', 'md') AND tipo NOT IN ('texto', 'im_texto') UNION ALL SELECT name, 'G5', 'informativo' FROM x"""),
    "c4_c17_findings": oracle("v3", ", " + _PAIRS + "SELECT l_orderkey, l_linenumber, seq, point, rule, severity FROM found"),
    "c5_c7_integrity": oracle("v3", """SELECT l_orderkey, l_linenumber, rule, severity FROM (
 SELECT *, 'I1' AS rule, CASE WHEN l_partkey % 17 = 0 THEN 'fallo' WHEN l_partkey % 9 < 2 THEN 'aviso' END AS severity FROM v3 WHERE categoria = 'imagen'
 UNION ALL SELECT *, 'I5', CASE WHEN l_partkey % 20 NOT IN (1, 2, 4, 8, 10, 12, 16, 32) THEN 'aviso' END FROM v3 WHERE categoria = 'imagen'
 UNION ALL SELECT *, 'A1', CASE WHEN l_partkey % 19 = 0 OR l_partkey % 6 = 0 THEN 'fallo' END FROM v3 WHERE categoria = 'av'
 UNION ALL SELECT *, 'A2', CASE WHEN l_partkey % 5 = 0 THEN 'aviso' END FROM v3 WHERE categoria = 'av'
 UNION ALL SELECT *, 'A3', CASE WHEN l_partkey * 10 NOT BETWEEN 8000 AND 192000 THEN 'aviso' END FROM v3 WHERE categoria = 'av'
 UNION ALL SELECT *, 'P1', CASE WHEN l_partkey % 8 = 0 THEN CASE WHEN l_partkey % 3 = 0 THEN 'aviso' ELSE 'fallo' END END FROM v3 WHERE categoria = 'pdf') WHERE severity IS NOT NULL"""),
    "c8_c18_tabular": oracle("v2", ", " + _TAB + "SELECT * FROM f"),
    "c10_density": oracle("v3", """SELECT l_orderkey, l_linenumber, rule, severity FROM (
 SELECT *, 'P4-dpi' AS rule, CASE WHEN abs(144 - (142 + l_partkey % 5)) > 1 THEN 'fallo' END AS severity FROM v3 UNION ALL SELECT *, 'P4-px', CASE WHEN abs(ancho_ent - ancho_sal) > 0.5 THEN 'fallo' END FROM v3
 UNION ALL SELECT *, 'P7', CASE WHEN ancho_sal > 900 AND l_partkey % 2 = 0 THEN 'aviso' END FROM v3) WHERE severity IS NOT NULL AND categoria = 'pdf'"""),
    "c8_data_rules": """WITH x AS (SELECT p_partkey AS k, p_name FROM part), f AS (
 SELECT k, 'D5-utf8' AS rule, 'fallo' AS severity FROM x WHERE k % 13 = 0 UNION ALL SELECT k, 'D5', 'fallo' FROM x WHERE k % 5 = 0 AND k % 13 <> 0
 UNION ALL SELECT k, 'D8', 'fallo' FROM x WHERE k % 2 = 0 AND (k % 9 = 0 OR k % 5 = 0 OR k % 13 = 0) UNION ALL SELECT k, 'D2', 'fallo' FROM x WHERE k % 2 = 1 AND (k % 11 = 0 OR k % 13 = 0 OR (k % 5 = 0 AND k % 9 <> 0))
 UNION ALL SELECT k, 'D4', 'aviso' FROM x WHERE k % 7 = 0) SELECT k AS p_partkey, rule, severity FROM f""",
    "c19_c21_writes": oracle("v11", ", " + _CENSUS + f""", n AS (SELECT *, {_FILE} AS fichero, job % 5 AS k FROM census), m AS (SELECT *, estado = 'nuevo' AS nuevo, nombre % 5 <> 0 AS dentro, k <> 3 OR {_TARGET} = 'mpd' AS varios,
  CASE WHEN k < 2 THEN regexp_full_match(fichero, 'f[0-9]+\\.png') WHEN k = 2 THEN regexp_full_match(fichero, 'hoja[0-9]+\\.svg') ELSE false END AS declarado, split_part(fichero, '.', 2) IN ('m4s', 'png', 'jpg') OR (k = 3 AND contains(fichero, 'salida')) AS satelite FROM n),
 g AS (SELECT job, sum(CASE WHEN nuevo AND dentro AND declarado THEN despues ELSE 0 END) AS declared, sum(CASE WHEN nuevo AND NOT dentro THEN despues ELSE 0 END) AS outside_bytes, count(*) FILTER (nuevo AND NOT dentro) AS outside, count(*) FILTER (nuevo AND dentro AND NOT declarado) AS beside,
  count(*) FILTER (nuevo AND dentro AND NOT declarado AND satelite AND varios) AS satellites, count(*) FILTER (estado = 'cambiado') AS changed, sum(CASE WHEN nuevo THEN despues ELSE 0 END) AS written FROM m GROUP BY job)
SELECT job, CASE WHEN outside > 0 THEN CASE WHEN outside_bytes > greatest(declared, 1) THEN 'fallo' ELSE 'aviso' END END AS n5, CASE WHEN beside > 0 THEN CASE WHEN beside = satellites THEN 'informativo' ELSE 'aviso' END END AS n7,
 CASE WHEN changed > 0 THEN 'aviso' END AS n8, CASE WHEN written > 0 THEN round(declared / written, 6) END AS n9 FROM g"""),
    "c20_numbered_outputs": oracle("v11", ", " + _CENSUS + f""", n AS (SELECT job, {_FILE} AS fichero FROM census WHERE estado = 'nuevo'), j AS (SELECT DISTINCT job, {_DECLARED} AS declarado FROM v11),
 m AS (SELECT j.job, declarado, CAST(regexp_extract(fichero, '[0-9]+') AS BIGINT) AS x FROM j JOIN n ON n.job = j.job AND CASE j.job % 5 WHEN 2 THEN regexp_full_match(fichero, 'hoja[0-9]+\\.svg') WHEN 3 THEN false WHEN 4 THEN false ELSE regexp_full_match(fichero, 'f[0-9]+\\.png') END),
 l AS (SELECT *, x - lag(x) OVER (PARTITION BY job ORDER BY x) > 1 AS hueco FROM m)
SELECT j.job, j.declarado, count(l.x) AS ficheros, min(x) AS primero, max(x) AS ultimo, CASE WHEN count(l.x) > 0 THEN count(*) FILTER (hueco) END AS huecos FROM j LEFT JOIN l ON l.job = j.job WHERE j.job % 5 <> 3 GROUP BY j.job, j.declarado"""),
    "c22_c27_coverage": oracle("v3", """SELECT l_orderkey, l_linenumber, concat_ws(',', '1_firma', CASE WHEN l_linenumber < 6 THEN '2_flujos' END, '3_integridad', CASE WHEN l_partkey % 5 > 0 THEN '4_pedido' END, CASE WHEN n_audio > 0 THEN '5_escritura' END, CASE WHEN l_linenumber > 1 THEN '6_cadena' END) AS cubiertos,
 concat(2 + CAST(l_linenumber < 6 AS INT) + CAST(l_partkey % 5 > 0 AS INT) + CAST(n_audio > 0 AS INT) + CAST(l_linenumber > 1 AS INT), '/6') AS ratio FROM v3"""),
    "c23_tabular_verdict": oracle("v2", ", " + _TAB + "SELECT v2.job, CASE WHEN max(CASE severity WHEN 'fallo' THEN 2 WHEN 'aviso' THEN 1 END) = 2 THEN 'fallo' WHEN max(CASE severity WHEN 'fallo' THEN 2 WHEN 'aviso' THEN 1 END) = 1 THEN 'aviso' WHEN NOT any_value(sin_sonda_ent) THEN 'ok' ELSE 'ok_parcial' END AS verdict FROM v2 LEFT JOIN f ON v2.job = f.job GROUP BY v2.job"),
    "c23_media_verdict": oracle("v3", ", " + _PAIRS + "SELECT * FROM verdict"),
    "c24_chain": oracle("v3", ", " + _PAIRS + "SELECT l_orderkey, CASE WHEN bool_or(verdict = 'fallo') THEN 'fallo' ELSE coalesce(arg_min(verdict, l_linenumber) FILTER (verdict <> 'ok'), 'ok') END AS verdict FROM verdict GROUP BY l_orderkey"),
    "c25_short": oracle("v3", ", " + _PAIRS + "SELECT l_orderkey, l_linenumber, CAST(r AS INTEGER) AS r, rule, severity, substr(message, 1, 110) AS message FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY seq, severity, message) AS r FROM found WHERE severity <> 'informativo') WHERE r <= 3"),
    "c26_summary": oracle("v3", ", " + _PAIRS + "SELECT v.l_orderkey, v.l_linenumber, concat_ws(' · ', verdict, x.line) AS line FROM verdict v LEFT JOIN (SELECT l_orderkey, l_linenumber, arg_min(rule || ': ' || message, CASE severity WHEN 'fallo' THEN 0 ELSE 100 END + seq) AS line FROM found GROUP BY l_orderkey, l_linenumber) x ON v.l_orderkey = x.l_orderkey AND v.l_linenumber = x.l_linenumber"),
    "c28_leftovers": oracle("v11", "SELECT d.job, count(*) AS n, CAST(sum(d.tam) AS BIGINT) AS bytes FROM v11 d WHERE fase = 'despues' AND NOT EXISTS (SELECT 1 FROM v11 a WHERE a.fase = 'antes' AND a.job = d.job AND a.nombre = d.nombre AND a.dir = d.dir) GROUP BY d.job"),
    "c29_batch": oracle("v12", "SELECT job, count(*) FILTER (estado = 'completed') AS converted, count(*) FILTER (estado = 'failed') AS failed, coalesce(array_to_string(list(event_id ORDER BY ts, event_id) FILTER (estado = 'completed' AND r <= 5), ','), '') AS outputs, CASE WHEN count(*) FILTER (estado = 'failed') = 0 THEN 'COMPLETADO' ELSE 'FALLIDO' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY job, estado ORDER BY ts, event_id) AS r FROM v12) GROUP BY job"),
    "j3_census": oracle("v11", ", " + _CENSUS + "SELECT * FROM census"),
}
