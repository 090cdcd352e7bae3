"""Queries of experiment statistics and of ordered choices."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..operators import statistics as st
from ..views import oracle, table, view

THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 13)]


def _v9(spark, sf):
    return view(spark, sf, "v9")


def a4_shares(spark: SparkSession, sf: str) -> DataFrame:
    return st.shares(_v9(spark, sf), "catalogo", "herramienta")


def a5_wilson(spark: SparkSession, sf: str) -> DataFrame:
    return st.rates(_v9(spark, sf), "catalogo", "estrato", F.col("herramienta") != "error")


def a6_fisher(spark: SparkSession, sf: str) -> DataFrame:
    g = _v9(spark, sf).groupBy("user_id").agg(*[F.count_if((F.col("herramienta") == "error") == e).alias(n) for e, n in ((True, "x"), (False, "y"))])
    t = g.select("user_id", F.col("x").alias("a"), F.col("y").alias("b"), F.floor(F.col("y") / 2).alias("c"), (F.col("x") * 2 + 1).alias("d"))
    return t.select("user_id", "a", "b", "c", "d", F.round(stats.fisher(*[F.col(k) for k in "abcd"]), 6).alias("p"))


def a7_weighted_rate(spark: SparkSession, sf: str) -> DataFrame:
    v = _v9(spark, sf)
    sizes = v.groupBy("estrato").agg((F.count_distinct("user_id") * 10).alias("size"))
    return st.weighted_rate(v, "estrato", F.when(F.col("event_id") % 6 > 0, F.col("herramienta") != "error"), sizes)


def a8_line(spark: SparkSession, sf: str) -> DataFrame:
    return st.line(view(spark, sf, "v8"), ["ajuste"], "metrica_a", "metrica_b")


def a9_steady(spark: SparkSession, sf: str) -> DataFrame:
    return st.steady(view(spark, sf, "v8").withColumn("m", F.round("metrica_a", 5)), "ajuste", F.col("doc"), "m")


def a10_two_way(spark: SparkSession, sf: str) -> DataFrame:
    return st.two_way(_grid(spark, sf), "ajuste", "doc", "y")


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    """A complete grid: mean discount by line number and supplier class."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    return l.groupBy((F.col("l_linenumber")).alias("ajuste"), (F.col("l_suppkey") % 5).alias("doc")).agg((F.avg("l_discount") * 100).alias("y"))


def a11_regret(spark: SparkSession, sf: str) -> DataFrame:
    return st.regret(_grid(spark, sf), "ajuste", "doc", "y")


def a12_a13_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return st.sweep(view(spark, sf, "v8_sweep").withColumn("desvio", F.round("desvio", 6)), "clase", "legitima", "desvio", THRESHOLDS)


def a14_gap(spark: SparkSession, sf: str) -> DataFrame:
    return st.gap(view(spark, sf, "v8_sweep"), "clase", "legitima", "desvio")


def a15_worst(spark: SparkSession, sf: str) -> DataFrame:
    return st.worst_cases(view(spark, sf, "v8_sweep").withColumn("desvio", F.round("desvio", 6)), "fuente", "desvio", ["l_orderkey", "l_linenumber"])


def a16_change(spark: SparkSession, sf: str) -> DataFrame:
    return st.change_summary(view(spark, sf, "v8"), "metrica_a", "metrica_b", ["ajuste"])


def a18_timings(spark: SparkSession, sf: str) -> DataFrame:
    return st.timings(view(spark, sf, "v12"), "job", F.struct("ts", "event_id"), "ms")


def a19_a20_stable_heads(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v1").withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    return st.stable_positions(v, "ext", "body", 64)


def a23_run_costs(spark: SparkSession, sf: str) -> DataFrame:
    v = _v9(spark, sf)
    return v.groupBy("catalogo").agg(F.round(F.avg("coste"), 5).alias("coste"), F.count("*").alias("llamadas"), F.round(F.count("*") / F.count_distinct("user_id", "dia"), 5).alias("por_dia"))


def a28_counters(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v12")
    return v.groupBy("estado").agg(F.count("*").alias("n"), F.count_distinct("job").alias("jobs"))


def a30_cost_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Verification against conversion for each order: median, least, largest, and ratio of the totals, by priority."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")  # noqa: E741
    part = l.groupBy("l_orderkey").agg(F.sum("l_tax").alias("verif"))
    x = o.join(part, o.o_orderkey == part.l_orderkey).withColumn("r", F.round(F.col("verif") / F.col("o_totalprice") * 1e6, 6))
    return x.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.median("r"), 5).alias("mediana"), F.min("r").alias("min"), F.max("r").alias("max"), F.round(F.sum("verif") / F.sum("o_totalprice") * 1e6, 5).alias("total"))


def a31_additivity(spark: SparkSession, sf: str) -> DataFrame:
    """Median of joint runs against the sum of the parts' medians, first repetition dropped, noise band 43."""
    v = view(spark, sf, "v12").withColumn("r", F.row_number().over(Window.partitionBy("job", "estado").orderBy("ts", "event_id"))).where("r > 1")
    m = v.groupBy("job").agg(*[F.median(F.when(F.col("estado") == e, F.col("ms"))).alias(e) for e in ("failed", "completed", "working")])
    d = F.col("working") - F.col("failed") - F.col("completed")
    return m.select("job", F.round(d, 5).alias("diferencia"), (F.abs(d) <= 43).alias("aditivo"))


def a35_crossing(spark: SparkSession, sf: str) -> DataFrame:
    return st.crossing(_curve(spark, sf), "o_orderpriority", "mes", "y", 0.0)


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by priority and month, against the mean of all cells."""
    g = table(spark, sf, "orders").groupBy("o_orderpriority", F.month("o_orderdate").alias("mes")).agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.avg("n").alias("m")))).select("o_orderpriority", "mes", (F.col("n") - F.col("m")).alias("y"))


def a36_monotone(spark: SparkSession, sf: str) -> DataFrame:
    return st.monotone(_curve(spark, sf), "o_orderpriority", "mes", "y")


def w2_argmins(spark: SparkSession, sf: str) -> DataFrame:
    return st.argmins(view(spark, sf, "v8"), "doc", "ajuste", "metrica_a", 1)


def w3_rank_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Inversions, ties broken and made between two metrics inside a family, and whether its winners change."""
    v = view(spark, sf, "v8").select("doc", F.round("metrica_a", 1).alias("a"), F.round("metrica_b", 1).alias("b"))
    return st.rank_changes(v, "doc", "a", "b")


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    """Beginnings of pages: the kind is what the host and the first letters show, the engine a digest of the page."""
    p = table(spark, sf, "pages")
    return p.select(F.concat(F.lit("k"), F.pmod("page_id", F.lit(12)).cast("string")).alias("formato"), F.concat(F.lit("m"), F.substring(F.md5(F.col("page_id").cast("string")), 1, 1)).alias("motor"), F.concat(F.expr("repeat(substr('RFIX', cast(page_id % 3 as int) + 1, 2), cast(page_id % 12 div 3 as int))"), F.coalesce("html", F.lit(""))).alias("cabeza"))


def a20_best_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return st.best_evidence(_heads(spark, sf), "formato", "motor", "cabeza")


def a20_shared_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return st.shared_prefixes(a20_best_evidence(spark, sf), "formato").withColumn("kinds", F.array_join("kinds", ","))


def w4_families(spark: SparkSession, sf: str) -> DataFrame:
    """Families in which exactly one token of the setting varies."""
    v = view(spark, sf, "v8").select("ajuste").distinct().withColumn("t", F.split("ajuste", " "))
    x = v.select("ajuste", F.posexplode("t").alias("pos", "tok"), "t").withColumn("mascara", F.concat_ws(" ", F.transform("t", lambda e, i: F.when(i == F.col("pos"), "*").otherwise(e))))
    return x.groupBy("mascara").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("tok")), ",").alias("valores")).where("n >= 2")


def w5_largest_moves(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v8").withColumn("d", F.round(F.abs(F.col("metrica_a") - F.col("metrica_b")), 5))
    return v.orderBy(F.desc("d"), "ajuste", "doc").limit(15).select("ajuste", "doc", "d")


def w6_batch_order(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v8")
    return v.withColumn("puesto", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "ajuste"))).select("doc", "ajuste", "n", "puesto").orderBy("doc", "puesto")


def w7_processed_before(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v12").withColumn("ms", F.round("ms", 3))
    return st.processed_before(v, "job", [F.col("ts"), F.col("event_id")], "ms", F.col("estado") == "working", F.col("estado") == "failed").select("job", "event_id", "resident")


def w8_numbering(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps and repeats in the numbers of each source's documents."""
    d = table(spark, sf, "documents").select("source", (F.col("doc_id") - F.col("doc_id") % 3).alias("num"))
    g = d.groupBy("source", "num").agg(F.count("*").alias("veces"))
    nxt = F.lead("num").over(Window.partitionBy("source").orderBy("num"))
    return g.withColumn("salto", nxt - F.col("num")).where("salto > 3 or veces > 1")


def w9_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return st.stratified(_v9(spark, sf), "estrato", "event_id", 300, 12, "semilla").select("estrato", "event_id")


QUERIES = {f.__name__: f for f in (a4_shares, a5_wilson, a6_fisher, a7_weighted_rate, a8_line, a9_steady, a10_two_way, a11_regret, a12_a13_sweep, a14_gap, a15_worst, a16_change, a18_timings, a19_a20_stable_heads, a20_best_evidence, a20_shared_prefixes, a23_run_costs, a28_counters, a30_cost_ratio, a31_additivity, a35_crossing, a36_monotone, w2_argmins, w3_rank_changes, w4_families, w5_largest_moves, w6_batch_order, w7_processed_before, w8_numbering, w9_stratified)}

_GRID = "WITH g AS (SELECT l_linenumber AS ajuste, l_suppkey % 5 AS doc, avg(l_discount) * 100 AS y FROM lineitem GROUP BY 1, 2)"
_CURVE = "WITH g AS (SELECT o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS mes, count(*) AS n FROM orders GROUP BY 1, 2), c AS (SELECT o_orderpriority, mes, n - (SELECT avg(n) FROM g) AS y FROM g)"
_SW = "SELECT l_orderkey, l_linenumber, fuente, clase, round(desvio, 6) AS d FROM v8_sweep"

_HEADS = """WITH h AS (SELECT 'k' || page_id % 12 AS formato, 'm' || substr(md5(CAST(page_id AS VARCHAR)), 1, 1) AS motor, repeat(substr('RFIX', CAST(page_id % 3 AS INT) + 1, 2), page_id % 12 // 3) || coalesce(html, '') AS cabeza FROM pages),
 g AS (SELECT formato, motor, list(cabeza) AS l, count(*) AS samples FROM h GROUP BY 1, 2), n AS (SELECT *, coalesce(list_max(list_filter(range(1, 65), lambda i: len(list_distinct(list_transform(l, lambda x: substr(x, 1, i)))) = 1 AND length(l[1]) >= i)), 0) AS n FROM g),
 e AS (SELECT formato, motor, samples, substr(l[1], 1, n) AS prefix FROM n QUALIFY row_number() OVER (PARTITION BY formato ORDER BY n DESC, motor) = 1)"""

ORACLE = {
    "a4_shares": oracle("v9", "SELECT catalogo, herramienta, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY catalogo), 6) AS share FROM v9 GROUP BY catalogo, herramienta"),
    "a5_wilson": oracle("v9", """, g AS (SELECT catalogo, estrato, count(*) FILTER (herramienta <> 'error') AS k, count(*) AS n FROM v9 GROUP BY GROUPING SETS ((catalogo, estrato), (catalogo)))
SELECT catalogo, estrato, k, n, round(k / n, 6) AS rate, round(greatest(0, (k / n + 1.96::DOUBLE * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96::DOUBLE * 1.96 / (4 * n * n))) / (1 + 1.96::DOUBLE * 1.96 / n)), 6) AS low,
 round(least(1, (k / n + 1.96::DOUBLE * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96::DOUBLE * 1.96 / (4 * n * n))) / (1 + 1.96::DOUBLE * 1.96 / n)), 6) AS high FROM g"""),
    "a6_fisher": oracle("v9", """, g AS (SELECT user_id, count(*) FILTER (herramienta = 'error') AS x, count(*) FILTER (herramienta <> 'error') AS y FROM v9 GROUP BY user_id),
 t AS (SELECT user_id, x AS a, y AS b, y // 2 AS c, x * 2 + 1 AS d FROM g),
 p AS (SELECT *, list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda k: exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1))) AS ps FROM t)
SELECT user_id, a, b, c, d, round(least(1, list_sum(list_filter(ps, lambda q: q <= ps[CAST(a - greatest(0, a - d) AS BIGINT) + 1] + 1e-12))), 6) AS p FROM p"""),
    "a7_weighted_rate": oracle("v9", """, g AS (SELECT estrato, count(*) FILTER (event_id % 6 > 0 AND herramienta <> 'error') AS k, count(*) FILTER (event_id % 6 = 0) AS u, count(*) AS n, count(DISTINCT user_id) * 10 AS size FROM v9 GROUP BY estrato)
SELECT round(sum(CASE WHEN n > u THEN k / (n - u) ELSE 0 END * size) / sum(size), 6) AS point, round(sum(k / n * size) / sum(size), 6) AS low, round(sum((k + u) / n * size) / sum(size), 6) AS high, CAST(sum(size) AS BIGINT) AS population FROM g"""),
    "a8_line": oracle("v8", "SELECT ajuste, round(coalesce(regr_slope(metrica_b, metrica_a), 0), 6) AS slope, round(avg(metrica_b) - coalesce(regr_slope(metrica_b, metrica_a), 0) * avg(metrica_a), 6) AS intercept, round(CASE WHEN min(metrica_b) = max(metrica_b) THEN 1 WHEN min(metrica_a) = max(metrica_a) THEN 0 ELSE regr_r2(metrica_b, metrica_a) END, 6) AS r2 FROM v8 GROUP BY ajuste"),
    "a9_steady": oracle("v8", "SELECT ajuste, count(*) AS n, arg_min(m, doc) AS first, arg_max(m, doc) AS last, min(m) AS low, max(m) AS high FROM (SELECT ajuste, doc, round(metrica_a, 5) AS m, row_number() OVER (PARTITION BY ajuste ORDER BY doc) AS r FROM v8) WHERE r > 1 GROUP BY ajuste"),
    "a10_two_way": _GRID + ", x AS (SELECT y, avg(y) OVER (PARTITION BY ajuste) AS ma, avg(y) OVER (PARTITION BY doc) AS mb, avg(y) OVER () AS m FROM g), s AS (SELECT sum((ma - m) ** 2) AS a, sum((mb - m) ** 2) AS b, sum((y - ma - mb + m) ** 2) AS ab, sum((y - m) ** 2) AS t FROM x) SELECT (SELECT count(*) = count(DISTINCT ajuste) * count(DISTINCT doc) FROM g) AS whole, round(100 * a / t, 4) AS ssa_pct, round(100 * b / t, 4) AS ssb_pct, round(100 * ab / t, 4) AS ssab_pct FROM s",
    "a11_regret": _GRID + ", b AS (SELECT doc, min(y) AS best FROM g GROUP BY doc) SELECT ajuste, round(avg(y - best), 6) AS mean, round(max(y - best), 6) AS worst FROM g JOIN b ON g.doc = b.doc GROUP BY ajuste HAVING count(DISTINCT g.doc) = (SELECT count(DISTINCT doc) FROM g)",
    "a12_a13_sweep": oracle("v8_sweep", f""", s AS ({_SW}), t AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold)
SELECT threshold, {', '.join(f"count(*) FILTER (clase {o} 'legitima' AND {h}) AS {k}_{w}" for k, h in (('both', 'abs(d) > threshold'), ('up', 'd > threshold'), ('down', 'd < -threshold')) for w, o in (('false', '='), ('caught', '<>')))},
 count(*) FILTER (clase = 'legitima' AND d > threshold) = 0 AND count(*) FILTER (clase <> 'legitima' AND d > threshold) = count(*) FILTER (clase <> 'legitima' AND d > 0) AS plateau_up,
 count(*) FILTER (clase = 'legitima' AND d < -threshold) = 0 AND count(*) FILTER (clase <> 'legitima' AND d < -threshold) = count(*) FILTER (clase <> 'legitima' AND d < 0) AS plateau_down FROM s CROSS JOIN t GROUP BY threshold"""),
    "a14_gap": oracle("v8_sweep", "SELECT round(max(abs(desvio)) FILTER (clase = 'legitima'), 6) AS legit_max, round(min(abs(desvio)) FILTER (clase <> 'legitima'), 6) AS other_min, CASE WHEN max(abs(desvio)) FILTER (clase = 'legitima') < min(abs(desvio)) FILTER (clase <> 'legitima') THEN 'hueco' ELSE 'sin umbral' END AS verdict FROM v8_sweep"),
    "a15_worst": oracle("v8_sweep", f", s AS ({_SW}), h AS (SELECT *, row_number() OVER (PARTITION BY fuente ORDER BY d DESC, l_orderkey, l_linenumber) AS rh, row_number() OVER (PARTITION BY fuente ORDER BY d, l_orderkey, l_linenumber) AS rl FROM s) SELECT fuente, max(d) FILTER (rh = 1) AS high, max(concat(l_orderkey, '-', l_linenumber)) FILTER (rh = 1) AS high_row, max(d) FILTER (rl = 1) AS low, max(concat(l_orderkey, '-', l_linenumber)) FILTER (rl = 1) AS low_row FROM h GROUP BY fuente"),
    "a16_change": oracle("v8", ", x AS (SELECT ajuste, round(metrica_b - metrica_a, 6) AS d FROM v8) SELECT ajuste, count(*) AS n, count(*) FILTER (abs(d) < 0.01) AS iguales, count(*) FILTER (abs(d) >= 0.5) AS m05, count(*) FILTER (abs(d) >= 2) AS m2, count(*) FILTER (abs(d) >= 6.3) AS m63, round(median(d), 5) AS mediana, round(avg(d), 5) AS media, round(min(d), 5) AS min, round(max(d), 5) AS max, round(max(abs(d)), 5) AS max_abs FROM x GROUP BY GROUPING SETS ((ajuste), ())"),
    "a18_timings": oracle("v12", """, x AS (SELECT *, count(*) OVER (PARTITION BY job) AS n, row_number() OVER (PARTITION BY job ORDER BY ms, ts, event_id) AS v, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS t FROM v12),
 g AS (SELECT job, any_value(n) AS n, median(ms) AS median, max(ms) FILTER (v = greatest(1, least(CAST(floor(0.9::DOUBLE * (n + 1)) AS BIGINT), n))) AS a, max(ms) FILTER (v = least(CAST(floor(0.9::DOUBLE * (n + 1)) AS BIGINT) + 1, n)) AS b, any_value(0.9::DOUBLE * (n + 1) - floor(0.9::DOUBLE * (n + 1))) AS f, min(ms) AS min, max(ms) AS max, median(ms) FILTER (t <= n // 2) AS h1, median(ms) FILTER (t > n // 2) AS h2 FROM x GROUP BY job)
SELECT job, n, round(median, 5) AS median, round(a + (b - a) * f, 5) AS p90, min, max, round(h2 / nullif(h1, 0), 5) AS drift, abs(h2 / nullif(h1, 0) - 1) > 0.2 AS dirty FROM g"""),
    "a19_a20_stable_heads": oracle("v1", """, h AS (SELECT lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext, body FROM v1), s AS (SELECT ext, least(64, min(length(body))) AS shortest, count(*) AS samples FROM h GROUP BY ext),
 p AS (SELECT h.ext, i AS pos, count(DISTINCT substr(body, i + 1, 1)) AS k FROM h JOIN s ON h.ext = s.ext CROSS JOIN range(64) r(i) WHERE i < shortest GROUP BY 1, 2)
SELECT p.ext, any_value(samples) AS samples, count(*) FILTER (k = 1) AS stable, CAST(coalesce(min(pos) FILTER (k > 1), any_value(shortest)) AS INTEGER) AS prefix FROM p JOIN s ON p.ext = s.ext GROUP BY p.ext"""),
    "a20_best_evidence": _HEADS + " SELECT formato, motor, samples, prefix FROM e",
    "a20_shared_prefixes": _HEADS + """, p AS (SELECT prefix, string_agg(formato, ',' ORDER BY formato) AS kinds FROM e WHERE length(prefix) >= 2 GROUP BY prefix)
SELECT p.prefix, p.kinds, arg_max(q.prefix, length(q.prefix)) AS under FROM p LEFT JOIN p q ON starts_with(p.prefix, q.prefix) AND q.prefix <> p.prefix GROUP BY p.prefix, p.kinds""",
    "a23_run_costs": oracle("v9", "SELECT catalogo, round(avg(coste), 5) AS coste, count(*) AS llamadas, round(count(*) / count(DISTINCT row(user_id, dia)), 5) AS por_dia FROM v9 GROUP BY catalogo"),
    "a28_counters": oracle("v12", "SELECT estado, count(*) AS n, count(DISTINCT job) AS jobs FROM v12 GROUP BY estado"),
    "a30_cost_ratio": "WITH p AS (SELECT l_orderkey, sum(l_tax) AS verif FROM lineitem GROUP BY 1), x AS (SELECT *, round(verif / o_totalprice * 1e6, 6) AS r FROM orders JOIN p ON o_orderkey = l_orderkey) SELECT o_orderpriority, count(*) AS n, round(median(r), 5) AS mediana, min(r) AS min, max(r) AS max, round(sum(verif) / sum(o_totalprice) * 1e6, 5) AS total FROM x GROUP BY 1",
    "a31_additivity": oracle("v12", ", v AS (SELECT *, row_number() OVER (PARTITION BY job, estado ORDER BY ts, event_id) AS r FROM v12), m AS (SELECT job, median(ms) FILTER (estado = 'failed') AS f, median(ms) FILTER (estado = 'completed') AS c, median(ms) FILTER (estado = 'working') AS w FROM v WHERE r > 1 GROUP BY job) SELECT job, round(w - f - c, 5) AS diferencia, abs(w - f - c) <= 43 AS aditivo FROM m"),
    "a35_crossing": _CURVE + ", p AS (SELECT *, lead(mes) OVER w AS x2, lead(y) OVER w AS y2 FROM c WINDOW w AS (PARTITION BY o_orderpriority ORDER BY mes)) SELECT o_orderpriority, round(min(mes + (x2 - mes) * (0 - y) / (y2 - y)), 5) AS at FROM p WHERE y < 0 AND y2 >= 0 GROUP BY 1",
    "a36_monotone": _CURVE + " SELECT o_orderpriority, bool_and(b IS NULL OR y >= b) AS monotone FROM (SELECT *, lag(y) OVER (PARTITION BY o_orderpriority ORDER BY mes) AS b FROM c) GROUP BY 1",
    "w2_argmins": oracle("v8", "SELECT doc, ajuste, y AS metrica_a FROM (SELECT doc, ajuste, round(metrica_a, 1) AS y, rank() OVER (PARTITION BY doc ORDER BY round(metrica_a, 1)) AS r FROM v8) WHERE r = 1"),
    "w3_rank_changes": oracle("v8", ", v AS (SELECT doc, ajuste, round(metrica_a, 1) AS a, round(metrica_b, 1) AS b FROM v8), p AS (SELECT v.doc, sign(v.a - w.a) AS sa, sign(v.b - w.b) AS sb FROM v JOIN v w ON v.doc = w.doc AND v.ajuste < w.ajuste), n AS (SELECT *, min(a) OVER (PARTITION BY doc) AS ma, min(b) OVER (PARTITION BY doc) AS mb FROM v), k AS (SELECT doc, bool_or((a = ma) <> (b = mb)) AS cambia FROM n GROUP BY doc) SELECT doc, count(*) AS pares, count(*) FILTER (sa * sb < 0) AS inversiones, count(*) FILTER (sa = 0 AND sb <> 0) AS deshechos, count(*) FILTER (sa <> 0 AND sb = 0) AS hechos, any_value(cambia) AS cambia FROM p JOIN k USING (doc) GROUP BY doc"),
    "w4_families": oracle("v8", ", t AS (SELECT DISTINCT ajuste, string_split(ajuste, ' ') AS t FROM v8), x AS (SELECT t, i FROM t CROSS JOIN range(1, 20) r(i) WHERE i <= len(t)), y AS (SELECT array_to_string(list_transform(t, lambda e, k: CASE WHEN k = i THEN '*' ELSE e END), ' ') AS mascara, t[i] AS tok FROM x) SELECT mascara, count(*) AS n, array_to_string(list(tok ORDER BY tok), ',') AS valores FROM y GROUP BY mascara HAVING count(*) >= 2"),
    "w5_largest_moves": oracle("v8", "SELECT ajuste, doc, round(abs(metrica_a - metrica_b), 5) AS d FROM v8 ORDER BY d DESC, ajuste, doc LIMIT 15"),
    "w6_batch_order": oracle("v8", "SELECT doc, ajuste, n, CAST(row_number() OVER (PARTITION BY doc ORDER BY n DESC, ajuste) AS INTEGER) AS puesto FROM v8"),
    "w7_processed_before": oracle("v12", ", e AS (SELECT *, sum(CASE WHEN estado = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM v12) SELECT job, event_id, max(CASE WHEN estado = 'working' THEN round(ms, 3) END) OVER (PARTITION BY job, epoch ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS resident FROM e"),
    "w8_numbering": "WITH g AS (SELECT source, doc_id - doc_id % 3 AS num, count(*) AS veces FROM documents GROUP BY 1, 2) SELECT * FROM (SELECT *, lead(num) OVER (PARTITION BY source ORDER BY num) - num AS salto FROM g) WHERE salto > 3 OR veces > 1",
    "w9_stratified": oracle("v9", ", n AS (SELECT estrato, count(*) AS n, (SELECT count(*) FROM v9) AS t FROM v9 GROUP BY estrato) SELECT estrato, event_id FROM (SELECT v9.estrato, event_id, greatest(12, round(300 * n / t)) AS q, row_number() OVER (PARTITION BY v9.estrato ORDER BY md5('semilla' || event_id), event_id) AS r FROM v9 JOIN n ON v9.estrato = n.estrato) WHERE r <= q"),
}
