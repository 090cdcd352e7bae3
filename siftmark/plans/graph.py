"""Queries of the conversion graph, of probes laid over it, and of sets of formats."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..views import oracle, table, view


def _e(spark, sf):
    return view(spark, sf, "v4_edges")


def _f(spark, sf):
    return view(spark, sf, "v4_formats")


def g1_build_edges(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    eng = s.groupBy(F.concat(F.lit("m"), (F.col("s_suppkey") % 7).cast("string")).alias("motor"), F.col("s_nationkey").alias("ext")).agg((F.max("s_acctbal") > 3000).alias("lee"), (F.min("s_acctbal") < 5000).alias("escribe"))
    return gr.build_edges(eng)


def g2_step_cost(spark: SparkSession, sf: str) -> DataFrame:
    """The cost of each live edge towards each final format."""
    final = _f(spark, sf).select(F.col("ext").alias("final"), "texto")
    x = _e(spark, sf).where("estado <> 'nominal'").crossJoin(F.broadcast(final))  # formats are a fixed small table
    return x.select("origen", "destino", "final", gr.step_cost(F.col("texto")).cast("double").alias("coste"))


def g3_first_hops(spark: SparkSession, sf: str) -> DataFrame:
    return gr.first_hops(_e(spark, sf), 3)


def a21_coverage(spark: SparkSession, sf: str) -> DataFrame:
    h = gr.first_hops(_e(spark, sf), 3)
    c = lambda k: F.count_if(F.col("saltos") <= k)
    return h.agg(c(1).alias("uno"), c(2).alias("dos"), c(3).alias("tres"), F.round(c(3) / c(1), 5).alias("factor"))


def g4_closure(spark: SparkSession, sf: str) -> DataFrame:
    return gr.closure(_e(spark, sf))


def _paths(spark, sf):
    return gr.paths(_e(spark, sf).withColumn("coste", F.col("coste").cast("double")), _f(spark, sf))


def g5_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("origen", "final", "nodos", "motores", "saltos", "coste", "rasteriza")


def _plans(spark, sf):
    """Choices for all pairs that up to four live hops join."""
    e = _e(spark, sf).withColumn("coste", F.col("coste").cast("double"))
    asked = gr.first_hops(e.where("estado <> 'nominal'"), 4).select("origen", F.col("destino").alias("final"))
    return gr.choose(gr.paths_between(asked, e, _f(spark, sf)))


def g6_w1_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Choices for all pairs among all their paths, each with its rank among them; formats have three live edges at most."""
    return gr.choose(_paths(spark, sf), ranked=True)


def g7_why_not(spark: SparkSession, sf: str) -> DataFrame:
    c, s = table(spark, sf, "customer").select((F.col("c_nationkey") + F.when(F.col("c_custkey") % 50 == 0, 100).otherwise(0)).alias("origen")).distinct(), table(spark, sf, "supplier").select((F.col("s_nationkey") + F.when(F.col("s_suppkey") % 20 == 0, 200).otherwise(0)).alias("destino")).distinct()
    return gr.why_not(c.crossJoin(F.broadcast(s)), _e(spark, sf).where("origen % 5 <> 0"))  # formats by formats, both small


def g8_loss_cost(spark: SparkSession, sf: str) -> DataFrame:
    w = spark.createDataFrame([("A", "semantica", 1000.0), ("N", "metrica", 40.0), ("R", "riesgo", 50.0)], "perdida string, clase string, peso double")
    v = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("perdida"), F.col("l_discount").alias("valor"))
    return gr.loss_cost(v, "l_orderkey", w)


def g9_targets(spark: SparkSession, sf: str) -> DataFrame:
    """For each source and target: the chosen path, hops, engines, and the first rasterising rejection."""
    p = _plans(spark, sf)
    bad = p.where("motivo = 'rasteriza'").groupBy("origen", "final").agg(F.min_by("nodos", "rango").alias("rechazo"))
    return p.where("rango = 1").join(bad, ["origen", "final"], "left").select("origen", "final", "nodos", "motores", "saltos", "motivo", "rechazo")


def _probe(spark, sf):
    """(origen, destino, motor, ms, sondeo, build, huella): measured edges of every third origin, with a fingerprint map."""
    e = _e(spark, sf).where("destino % 3 <> 0")
    return e.select("origen", "destino", "motor", ((F.col("origen") * 31 + F.col("destino")) % 500).alias("ms"), F.when((F.col("origen") + F.col("destino")) % 4 == 0, "nominal").when(F.col("origen") % 7 == 3, "ilegible").otherwise("real").alias("sondeo"), (F.col("origen") % 3 > 0).alias("vale"))


def j1_probe_overlay(spark: SparkSession, sf: str) -> DataFrame:
    p = _probe(spark, sf).where("sondeo IN ('real', 'nominal')")
    x = _e(spark, sf).join(p, ["origen", "destino", "motor"], "left")
    return x.select("origen", "destino", "motor", F.coalesce("sondeo", "estado").alias("estado"), F.round(F.when(F.col("sondeo") == "real", 1 + F.col("ms") / 100000).otherwise(F.col("coste")).cast("double"), 6).alias("coste"))


def j2_valid_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' probes against what customers have installed; engines of either side that the other lacks are met too."""
    part = lambda n, k, m: F.when(k % m > 0, F.concat(F.lit(n), (k % m).cast("string")))
    fingerprint = lambda parts: F.map_filter(F.create_map(*[x for n, v in parts.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    none = F.when(s % 13 == 0, F.lit(None)).otherwise(fingerprint({"bin": part("b", s, 11), "lib": part("l", s, 4), "fmt": part("f", s, 9)}))
    probes = table(spark, sf, "supplier").select(s.alias("motor"), F.when(s % 5 > 0, (F.col("s_nationkey") % 2).cast("string")).alias("build"), F.when(s % 3 > 0, (F.col("s_nationkey") % 3).cast("string")).otherwise("").alias("interprete"), none.alias("huella"))
    there = table(spark, sf, "customer").where("c_custkey % 7 > 0").select(c.alias("motor"), (F.col("c_nationkey") % 2).cast("string").alias("build"), F.when(c % 6 > 0, (F.col("c_nationkey") % 3).cast("string")).alias("interprete"), fingerprint({"bin": part("b", c, 11), "lib": part("l", c + 4 * (c % 3), 8), "os": part("o", c, 2)}).alias("huella"))
    return gr.guarded_probes(probes, there)


def j11_second_pass(spark: SparkSession, sf: str) -> DataFrame:
    e = _e(spark, sf).select("origen", "destino", "motor", "estado")
    again = e.where("(origen + destino) % 2 = 0").select("origen", "destino", "motor", F.when(F.col("estado") == "sin_sondear", "real").otherwise(F.col("estado")).alias("nuevo"))
    return e.join(again, ["origen", "destino", "motor"], "left").select("origen", "destino", "motor", F.coalesce("nuevo", "estado").alias("estado"))


def _halves(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ext"))
    st = lambda a, b: F.when((F.col("ext") * a) % 5 == b, "muerta").when((F.col("ext") * a) % 7 == b, "indeterminada").otherwise("viva")
    return n.select(F.col("ext").alias("origen"), st(3, 1).alias("entra")), n.select(F.col("ext").alias("destino"), st(2, 2).alias("sale"))


def _half_edges(spark, sf):
    i, o = _halves(spark, sf)
    x = _e(spark, sf).join(i, "origen").join(o, "destino")
    rank = F.when((F.col("entra") == "viva") & (F.col("sale") == "viva"), 3).when((F.col("entra") == "muerta") | (F.col("sale") == "muerta"), 1).otherwise(2)
    blame = F.when(F.col("entra") != "viva", F.when(F.col("sale") != "viva", "ambas").otherwise("entrada")).when(F.col("sale") != "viva", "salida").otherwise("ninguna")
    return x.select("origen", "destino", "motor", rank.alias("rango"), blame.alias("culpa"))


def j12_half_edges(spark: SparkSession, sf: str) -> DataFrame:
    g = _half_edges(spark, sf).groupBy("origen", "destino").agg(F.max("rango").alias("r"), F.max_by("culpa", F.struct("rango", "motor")).alias("culpa"))
    return g.select("origen", "destino", F.when(F.col("r") == 3, "viva").when(F.col("r") == 2, "indeterminada").otherwise("muerta").alias("estado"), "culpa")


def a32_what_if(spark: SparkSession, sf: str) -> DataFrame:
    """States with and without some engines: an edge leaves only if all its engines do."""
    e = _half_edges(spark, sf).withColumn("fuera", F.col("motor") == "m1")
    count = lambda x, name: x.groupBy("rango").agg(F.count("*").alias(name))
    pair = e.groupBy("origen", "destino").agg(F.max("rango").alias("rango"), F.max(F.when(~F.col("fuera"), F.col("rango"))).alias("sin"))
    a, b = count(pair, "todas"), count(pair.where("sin IS NOT NULL").select(F.col("sin").alias("rango")), "restantes")
    return a.join(b, "rango", "full_outer").select("rango", F.coalesce("todas", F.lit(0)).alias("todas"), F.coalesce("restantes", F.lit(0)).alias("restantes"))


def a33_blame(spark: SparkSession, sf: str) -> DataFrame:
    g = _half_edges(spark, sf).where("rango < 3").groupBy("origen", "destino").agg(F.array_join(F.array_sort(F.collect_set("culpa")), "+").alias("culpas"))
    return g.groupBy("culpas").agg(F.count("*").alias("aristas"))


def a34_reasons(spark: SparkSession, sf: str) -> DataFrame:
    x = _half_edges(spark, sf).join(_e(spark, sf).select("origen", "destino", "motor", "estado"), ["origen", "destino", "motor"])
    return x.groupBy("estado", "culpa").agg(F.count("*").alias("n"), F.count_distinct("motor").alias("motores"), (F.count_distinct("motor") >= 2).alias("varios"))


def a26_probe_tally(spark: SparkSession, sf: str) -> DataFrame:
    return _e(spark, sf).groupBy("motor").agg(*[F.count_if(F.col("estado") == k).alias(k) for k in ("real", "nominal", "sin_sondear")])


def u1_pair_buckets(spark: SparkSession, sf: str) -> DataFrame:
    e = _e(spark, sf).select("origen", "destino").distinct()
    f = _f(spark, sf).select("ext", "familia", (F.col("ext") % 4 < 2).alias("popular"))
    x = e.join(f.toDF("origen", "fo", "po"), "origen").join(f.toDF("destino", "fd", "pd"), "destino")
    return x.select("origen", "destino", F.when(F.col("po") & F.col("pd"), "sustantiva").when(F.col("fo") != F.col("fd"), "cruzada").otherwise("ruido").alias("cubo"))


def u2_contract(spark: SparkSession, sf: str) -> DataFrame:
    """What a conversion must keep: what was measured in the source and the target can hold."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey"))
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"), F.collect_set(F.when(F.col("l_linenumber") < 3, F.col("l_returnflag"))).alias("c"))  # noqa: E741
    return o.join(l, o.o_orderkey == l.l_orderkey).select("o_orderkey", F.array_join(F.array_sort(F.array_intersect("a", "c")), ",").alias("contrato"))


def u3_new_and_resolved(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    old, new = l.where("l_shipdate < DATE '1997-01-01'").select("l_partkey", "l_returnflag").distinct(), l.where("l_shipdate >= DATE '1996-06-01'").select("l_partkey", "l_returnflag").distinct()
    return new.exceptAll(old).withColumn("cambio", F.lit("nuevo")).unionByName(old.exceptAll(new).withColumn("cambio", F.lit("resuelto")))


def u4_engine_sets(spark: SparkSession, sf: str) -> DataFrame:
    a = _e(spark, sf).select("origen", "destino", "motor")
    b = a.select(F.col("destino").alias("origen"), F.col("origen").alias("destino"), "motor")
    return a.unionByName(b).groupBy("origen", "destino").agg(F.array_join(F.array_sort(F.collect_set("motor")), ",").alias("motores"))


QUERIES = {f.__name__: f for f in (g1_build_edges, g2_step_cost, g3_first_hops, a21_coverage, g4_closure, g5_paths, g6_w1_plan, g7_why_not, g8_loss_cost, g9_targets, j1_probe_overlay, j2_valid_probes, j11_second_pass, j12_half_edges, a26_probe_tally, a32_what_if, a33_blame, a34_reasons, u1_pair_buckets, u2_contract, u3_new_and_resolved, u4_engine_sets)}

_HOPS = """e AS (SELECT DISTINCT origen, destino FROM v4_edges), w AS (SELECT origen, destino, 1 AS k FROM e UNION SELECT w.origen, e.destino, k + 1 FROM w JOIN e ON w.destino = e.origen WHERE k < {k}),
 h AS (SELECT origen, destino, min(k) AS saltos FROM w WHERE origen <> destino GROUP BY ALL)"""
_LIVE = "e AS (SELECT DISTINCT origen, destino FROM v4_edges WHERE estado <> 'nominal' AND origen % 5 <> 0), c AS (SELECT origen, destino FROM e UNION SELECT c.origen, e.destino FROM c JOIN e ON c.destino = e.origen)"
_PATHS = """x AS (SELECT e.origen, e.destino, motor, CAST(coste AS DOUBLE) + CASE WHEN estado = 'sin_sondear' THEN 2 ELSE 0 END AS c, CAST(rasteriza AS INT) AS r, CAST(coalesce(f.perdida, false) AS INT) AS p FROM v4_edges e LEFT JOIN v4_formats f ON e.destino = f.ext WHERE estado <> 'nominal'),
 y AS (SELECT origen, destino AS final, [origen, destino] AS nodes, [motor] AS ms, c, r, p FROM x UNION ALL SELECT y.origen, x.destino, list_append(nodes, x.destino), list_append(ms, x.motor), y.c + x.c, y.r + x.r, y.p + x.p FROM y JOIN x ON y.final = x.origen WHERE len(ms) < 4 AND NOT list_contains(nodes, x.destino)),
 z AS (SELECT origen, final, array_to_string(nodes, '>') AS nodos, array_to_string(ms, ',') AS motores, CAST(len(ms) AS INTEGER) AS saltos, c + CASE WHEN coalesce(f.texto, false) THEN r * 1000 ELSE 0 END + 4 * greatest(0, p - 1) AS coste, r > 0 AS rasteriza, 4 * greatest(0, p - 1) AS pena, coalesce(f.texto, false) AS texto FROM y LEFT JOIN v4_formats f ON y.final = f.ext)"""
_PLAN = """, k AS (SELECT *, row_number() OVER (PARTITION BY origen, final ORDER BY coste, saltos, nodos, motores) AS rango, row_number() OVER (PARTITION BY origen, final, rasteriza ORDER BY coste, saltos, nodos, motores) AS rr FROM z),
 plan AS (SELECT a.origen, a.final, CAST(least(a.rango, 9) AS INTEGER) AS rango, a.nodos, a.motores, a.saltos, a.coste, a.rasteriza, CASE WHEN a.rango = 1 THEN CASE WHEN a.rasteriza AND a.texto THEN 'unico: rasteriza' ELSE 'elegido' END WHEN a.rasteriza AND NOT b.rasteriza AND a.texto THEN 'rasteriza' WHEN a.saltos < b.saltos THEN CASE WHEN a.pena > b.pena THEN 'mas corto, mas perdidas' ELSE 'mas corto, mas caro' END ELSE 'mas caro' END AS motivo
  FROM k a JOIN k b ON a.origen = b.origen AND a.final = b.final AND b.rango = 1 WHERE a.rango <= 8 OR (a.rasteriza AND a.rr = 1))"""
_RANKED = _PLAN.replace("least(a.rango, 9)", "a.rango")  # the rank among all paths, also of the rasterising path that is added
_HALF = """n AS (SELECT n_nationkey AS ext FROM nation), i AS (SELECT ext, CASE WHEN ext * 3 % 5 = 1 THEN 'muerta' WHEN ext * 3 % 7 = 1 THEN 'indeterminada' ELSE 'viva' END AS s FROM n), o AS (SELECT ext, CASE WHEN ext * 2 % 5 = 2 THEN 'muerta' WHEN ext * 2 % 7 = 2 THEN 'indeterminada' ELSE 'viva' END AS s FROM n),
 h AS (SELECT e.*, CASE WHEN i.s = 'viva' AND o.s = 'viva' THEN 3 WHEN i.s = 'muerta' OR o.s = 'muerta' THEN 1 ELSE 2 END AS rango, CASE WHEN i.s <> 'viva' THEN CASE WHEN o.s <> 'viva' THEN 'ambas' ELSE 'entrada' END WHEN o.s <> 'viva' THEN 'salida' ELSE 'ninguna' END AS culpa FROM v4_edges e JOIN i ON e.origen = i.ext JOIN o ON e.destino = o.ext)"""

ORACLE = {
    "g1_build_edges": "WITH g AS (SELECT concat('m', s_suppkey % 7) AS motor, s_nationkey AS ext, max(s_acctbal) > 3000 AS lee, min(s_acctbal) < 5000 AS escribe FROM supplier GROUP BY 1, 2) SELECT a.motor, a.ext AS origen, b.ext AS destino FROM g a JOIN g b ON a.motor = b.motor WHERE a.lee AND b.escribe AND a.ext <> b.ext",
    "g2_step_cost": oracle("v4_edges v4_formats", "SELECT origen, destino, f.ext AS final, CAST(coste AS DOUBLE) + CASE WHEN rasteriza AND f.texto THEN 1000 ELSE 0 END + CASE WHEN estado = 'sin_sondear' THEN 2 ELSE 0 END AS coste FROM v4_edges CROSS JOIN v4_formats f WHERE estado <> 'nominal'"),
    "g3_first_hops": oracle("v4_edges", ", " + _HOPS.format(k=3) + " SELECT origen, destino, CAST(saltos AS INTEGER) AS saltos FROM h"),
    "a21_coverage": oracle("v4_edges", ", " + _HOPS.format(k=3) + " SELECT count(*) FILTER (saltos <= 1) AS uno, count(*) FILTER (saltos <= 2) AS dos, count(*) AS tres, round(count(*) / count(*) FILTER (saltos <= 1), 5) AS factor FROM h"),
    "g4_closure": oracle("v4_edges", ", e AS (SELECT DISTINCT origen, destino FROM v4_edges), c AS (SELECT origen, destino FROM e UNION SELECT c.origen, e.destino FROM c JOIN e ON c.destino = e.origen) SELECT * FROM c WHERE origen <> destino"),
    "g5_paths": oracle("v4_edges v4_formats", ", " + _PATHS + " SELECT origen, final, nodos, motores, saltos, coste, rasteriza FROM z"),
    "g6_w1_plan": oracle("v4_edges v4_formats", ", " + _PATHS + _RANKED + " SELECT * FROM plan"),
    "g7_why_not": oracle("v4_edges", ", " + _LIVE + """, r AS (SELECT * FROM (SELECT DISTINCT c_nationkey + CASE WHEN c_custkey % 50 = 0 THEN 100 ELSE 0 END AS origen FROM customer) CROSS JOIN (SELECT DISTINCT s_nationkey + CASE WHEN s_suppkey % 20 = 0 THEN 200 ELSE 0 END AS destino FROM supplier)),
 a AS (SELECT * FROM v4_edges WHERE origen % 5 <> 0)
SELECT origen, destino, CASE WHEN origen NOT IN (SELECT origen FROM a) THEN 'nadie lee' WHEN destino NOT IN (SELECT destino FROM a) THEN 'nadie escribe' ELSE 'inalcanzable' END AS motivo, (SELECT count(*) FROM a WHERE a.destino = r.destino AND estado = 'nominal') AS muertas
FROM r WHERE origen <> destino AND NOT EXISTS (SELECT 1 FROM c WHERE c.origen = r.origen AND c.destino = r.destino)"""),
    "g8_loss_cost": "WITH g AS (SELECT l_orderkey, sum(CASE l_returnflag WHEN 'A' THEN 1000 * l_discount ELSE 0 END) AS s, sum(CASE l_returnflag WHEN 'N' THEN 40 * l_discount ELSE 0 END) AS m, sum(CASE l_returnflag WHEN 'R' THEN 50 * l_discount ELSE 0 END) AS r FROM lineitem GROUP BY 1) SELECT l_orderkey, round(s, 5) AS semantica, round(m, 5) AS metrica, round(r, 5) AS riesgo, round(s + m + r, 5) AS coste, s + m + r < 500 AS aceptable FROM g",
    "g9_targets": oracle("v4_edges v4_formats", ", " + _PATHS + _PLAN + " SELECT p.origen, p.final, p.nodos, p.motores, p.saltos, p.motivo, b.rechazo FROM plan p LEFT JOIN (SELECT origen, final, arg_min(nodos, rango) AS rechazo FROM plan WHERE motivo = 'rasteriza' GROUP BY ALL) b ON p.origen = b.origen AND p.final = b.final WHERE p.rango = 1"),
    "j1_probe_overlay": oracle("v4_edges", ", p AS (SELECT origen, destino, motor, (origen * 31 + destino) % 500 AS ms, CASE WHEN (origen + destino) % 4 = 0 THEN 'nominal' WHEN origen % 7 = 3 THEN 'ilegible' ELSE 'real' END AS s FROM v4_edges WHERE destino % 3 <> 0) SELECT e.origen, e.destino, e.motor, coalesce(s, estado) AS estado, round(CAST(CASE WHEN s = 'real' THEN 1 + ms / 100000 ELSE coste END AS DOUBLE), 6) AS coste FROM v4_edges e LEFT JOIN p ON e.origen = p.origen AND e.destino = p.destino AND e.motor = p.motor AND s <> 'ilegible'"),
    "j2_valid_probes": """WITH p AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey % 2 END AS b, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey % 3 END AS i, s_suppkey % 13 = 0 OR (s_suppkey % 11 = 0 AND s_suppkey % 4 = 0 AND s_suppkey % 9 = 0) AS sin FROM supplier),
 x AS (SELECT p.*, c_custkey, c_nationkey % 2 AS nb, CASE WHEN c_custkey % 6 > 0 THEN c_nationkey % 3 END AS ni, NOT sin AND k % 4 > 0 AND (k + 4 * (k % 3)) % 8 > 0 AND k % 4 <> (k + 4 * (k % 3)) % 8 AS lib FROM p LEFT JOIN customer ON c_custkey = k AND c_custkey % 7 > 0),
 e AS (SELECT *, CASE WHEN c_custkey IS NULL THEN 'sin_instalar' WHEN b <> nb THEN 'build_distinto' WHEN i IS NOT NULL AND i IS DISTINCT FROM ni THEN 'interprete_distinto' WHEN lib THEN 'caducada' ELSE 'valida' END AS estado FROM x)
SELECT k AS motor, estado, CASE WHEN estado = 'caducada' THEN 'lib' END AS partes, CASE WHEN estado = 'valida' THEN concat_ws(',', CASE WHEN i IS NULL THEN 'sin_interprete' END, CASE WHEN sin THEN 'sin_huella' END) END AS nota, estado = 'valida' AS vale FROM e""",
    "j11_second_pass": oracle("v4_edges", "SELECT origen, destino, motor, CASE WHEN (origen + destino) % 2 = 0 AND estado = 'sin_sondear' THEN 'real' ELSE estado END AS estado FROM v4_edges"),
    "j12_half_edges": oracle("v4_edges", ", " + _HALF + " SELECT origen, destino, CASE max(rango) WHEN 3 THEN 'viva' WHEN 2 THEN 'indeterminada' ELSE 'muerta' END AS estado, arg_max(culpa, row(rango, motor)) AS culpa FROM h GROUP BY origen, destino"),
    "a26_probe_tally": oracle("v4_edges", "SELECT motor, count(*) FILTER (estado = 'real') AS real, count(*) FILTER (estado = 'nominal') AS nominal, count(*) FILTER (estado = 'sin_sondear') AS sin_sondear FROM v4_edges GROUP BY motor"),
    "a32_what_if": oracle("v4_edges", ", " + _HALF + ", p AS (SELECT max(rango) AS a, max(rango) FILTER (motor <> 'm1') AS b FROM h GROUP BY origen, destino) SELECT k AS rango, (SELECT count(*) FROM p WHERE a = k) AS todas, (SELECT count(*) FROM p WHERE b = k) AS restantes FROM (SELECT DISTINCT unnest([a, b]) AS k FROM p) WHERE k IS NOT NULL"),
    "a33_blame": oracle("v4_edges", ", " + _HALF + ", p AS (SELECT array_to_string(list_sort(list_distinct(list(culpa))), '+') AS culpas FROM h WHERE rango < 3 GROUP BY origen, destino) SELECT culpas, count(*) AS aristas FROM p GROUP BY culpas"),
    "a34_reasons": oracle("v4_edges", ", " + _HALF + " SELECT estado, culpa, count(*) AS n, count(DISTINCT motor) AS motores, count(DISTINCT motor) >= 2 AS varios FROM h GROUP BY estado, culpa"),
    "u1_pair_buckets": oracle("v4_edges v4_formats", "SELECT DISTINCT origen, destino, CASE WHEN origen % 4 < 2 AND destino % 4 < 2 THEN 'sustantiva' WHEN a.familia <> b.familia THEN 'cruzada' ELSE 'ruido' END AS cubo FROM v4_edges JOIN v4_formats a ON origen = a.ext JOIN v4_formats b ON destino = b.ext"),
    "u2_contract": "SELECT o_orderkey, coalesce(array_to_string(list_sort(list_distinct(list(l_returnflag) FILTER (l_linenumber < 3))), ','), '') AS contrato FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "u3_new_and_resolved": "WITH o AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_shipdate < DATE '1997-01-01'), n AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_shipdate >= DATE '1996-06-01') SELECT *, 'nuevo' AS cambio FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'resuelto' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)",
    "u4_engine_sets": oracle("v4_edges", "SELECT origen, destino, array_to_string(list_sort(list_distinct(list(motor))), ',') AS motores FROM (SELECT origen, destino, motor FROM v4_edges UNION ALL SELECT destino, origen, motor FROM v4_edges) GROUP BY origen, destino"),
}
