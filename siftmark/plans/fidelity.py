"""Queries of text and series fidelity."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import fidelity as fd
from ..views import READINGS, oracle, table, view
from .scalars import _NORM

_N10 = _NORM["n10"].replace("lower(x)", "lower({x})")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    fold = lambda c: text.normal(F.col(c), fold=True).alias(c)
    return view(spark, sf, "v5").select("doc_id", fold("ref"), fold("lectura_a"), fold("lectura_b"))


def y1_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Texts are dealt out once for both sides, into as many tasks as the distances want; readings are made where they are compared."""
    n = fd.tasks(spark)
    documents = table(spark, sf, "documents").repartition(n, "doc_id")
    t = documents.join(view(spark, sf, "v5_ajeno", documents=documents).repartition(n, "doc_id"), "doc_id")
    t = t.select("doc_id", F.col("text").alias("ref"), *[F.expr(x).alias(c) for c, x in READINGS.items()], "ajeno")
    return fd.error_rates(t, "doc_id", "ref", ["lectura_a", "lectura_b", "ajeno"]).withColumn("metrica", F.lit("acentos plegados"))


def y2_phrase_recall(spark: SparkSession, sf: str) -> DataFrame:
    t = _texts(spark, sf).where(F.length("ref") >= 60)
    t = t.select("doc_id", F.array(F.substring("ref", 1, 20), F.substring("ref", 31, 20)).alias("frases"), "lectura_b")
    return fd.phrase_recall(t, "doc_id", "frases", "lectura_b").withColumnRenamed("phrase", "frase")


def y3_containment(spark: SparkSession, sf: str) -> DataFrame:
    o = _texts(spark, sf).select("doc_id", fd.overlap(5, False)(F.col("ref"), F.col("lectura_b")).alias("o")).where("o.in_a > 0")
    share = F.col("o.common") / F.col("o.in_a")
    return o.select("doc_id", F.round(share, 6).alias("cobertura"), fd.containment_class(share).alias("clase"))


def y4_agreement(spark: SparkSession, sf: str) -> DataFrame:
    o = _texts(spark, sf).select("doc_id", fd.overlap(1, True)(F.col("lectura_b"), F.col("ref")).alias("o")).where("o.in_a + o.in_b > 0")
    dice = 2.0 * F.col("o.common") / (F.col("o.in_a") + F.col("o.in_b"))
    return o.select("doc_id", F.round(dice, 6).alias("acuerdo"), fd.agreement_class(dice).alias("clase"))


def y5_text_kept(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v6").withColumn("sal", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.substring("text", 1, 8)).when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("c"))).otherwise(F.concat(F.lit(" \n"), F.col("text"))))
    return v.select("doc_id", fd.text_kept(F.col("text"), F.col("sal"), F.col("doc_id") % 2 == 0).alias("regla"))


def _series(spark: SparkSession, sf: str) -> DataFrame:
    """(pair, channel, pos, a, b) of the embeddings' components; b is a copy, rounded, or silent on channel 1."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pair"), F.posexplode("embedding").alias("pos", "x"))
    a = F.col("x").cast("double")
    b = F.when(F.col("pair") % 3 == 0, a).when(F.col("pair") % 3 == 1, F.round(a, 2)).when(F.col("pos") % 2 == 1, 0.0).otherwise(a)
    return v.select("pair", (F.col("pos") % 2).alias("channel"), "pos", a.alias("a"), b.alias("b"))


def y6_y7_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = fd.errors(_series(spark, sf), ["pair"])
    rule = F.when(F.col("rmse") > 0, F.coalesce(fd.psnr_rule(F.col("psnr"), F.col("pair") % 11 == 0, F.col("pair") % 7 == 0, F.col("pair") % 5 == 0), F.lit("informativo")))
    return e.select("pair", F.round("rmse", 6).alias("rmse"), F.round(F.when(F.col("psnr") < 1000, F.col("psnr")), 4).alias("psnr"), "n", rule.alias("severity"))


def y8_silent_channel(spark: SparkSession, sf: str) -> DataFrame:
    s = fd.silent_channels(_series(spark, sf), ["pair"])
    return s.select("pair", "channel", F.round("in_db", 5).alias("in_db"), (F.col("out_db") == float("-inf")).alias("mudo"), "severity")


def y9_stream_identity(spark: SparkSession, sf: str) -> DataFrame:
    s = _series(spark, sf)
    a = s.select("pair", "pos", F.col("a").alias("v"))
    b = s.where((F.col("pair") % 4 != 1) | (F.col("pos") >= 3)).select("pair", F.when(F.col("pair") % 4 == 1, F.col("pos") - 3).otherwise(F.col("pos")).alias("pos"), F.col("b").alias("v"))
    return fd.stream_identity(a, b, "pair", F.col("pair") % 2 == 1)


def y10_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of eight values, compared by hash in both directions."""
    s = _series(spark, sf).withColumn("frame", F.floor(F.col("pos") / 8).cast("int"))
    h = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: F.floor(x[c] * 1000000).cast("long").cast("string")), ","))
    f = s.groupBy("pair", "frame").agg(h("a").alias("ha"), h("b").alias("hb"))
    return f.groupBy("pair").agg(F.count("*").alias("frames"), F.count_if(F.col("ha") != F.col("hb")).alias("distintos")).withColumn("severity", F.when((F.col("distintos") > 0) & (F.col("pair") % 2 == 0), "fallo"))


def y11_tags(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v11")
    a, b = v.where("fase = 'antes'").select("job", "nombre", F.col("tam").alias("a")), v.where("fase = 'despues'").select("job", "nombre", F.col("tam").alias("b"))
    both = a.join(b, ["job", "nombre"], "full_outer")
    g = both.groupBy("job").agg(F.count("a").alias("de_entrada"), F.count_if(F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a") != F.col("b")))).alias("perdidas"))
    return g.select("job", "de_entrada", "perdidas", F.when(F.col("de_entrada") == 0, "informativo").when(F.col("perdidas") > 0, "fallo").alias("severity"))


def y12_p22_palette(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the colours of a picture (its components in three channels) are a regular grid."""
    s = _series(spark, sf).withColumn("q", F.floor(F.col("a") * 4).cast("int")).withColumn("px", F.floor(F.col("pos") / 3).cast("int"))
    p = s.groupBy("pair", "px").agg(*[F.max(F.when(F.col("pos") % 3 == i, F.col("q"))).alias(c) for i, c in enumerate("rgb")])
    g = p.groupBy("pair").agg(F.count_distinct(F.struct(F.coalesce("r", F.lit(-99)), F.coalesce("g", F.lit(-99)), F.coalesce("b", F.lit(-99)))).alias("colores"), *[F.count_distinct(F.coalesce(c, F.lit(-99))).alias("n" + c) for c in "rgb"])
    return g.select("pair", "colores", (F.col("nr") * F.col("ng") * F.col("nb") == F.col("colores")).alias("rejilla"))


def y13_fidelity_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Worst finding of a pair; ok only with a coverage that isn't empty and all true."""
    e, s = y6_y7_errors(spark, sf), y8_silent_channel(spark, sf).groupBy("pair").agg(F.max("severity").alias("mudo"))
    x = e.join(s, "pair").withColumn("cubierto", F.col("pair") % 4 > 0)
    bad = (F.col("severity") == "fallo") | (F.col("mudo") == "fallo")
    return x.select("pair", F.when(F.coalesce(bad, F.lit(False)) | F.coalesce(F.col("mudo") == "fallo", F.lit(False)), "fallo").when(F.col("severity") == "aviso", "aviso").when(F.col("cubierto"), "ok").otherwise("ok_parcial").alias("verdict"))


def y14_five_classes(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v3")
    loss = F.when(F.col("sr_sal") != F.col("sr_ent"), "grave").when(F.col("prof_sal") < F.col("prof_ent"), "leve").when(F.col("l_partkey") % 50 == 0, "rota").otherwise("ninguna")
    return fd.five_classes(v.select("l_orderkey", loss.alias("severity"), (F.col("destino") != "jpg").alias("possible")), "l_orderkey")


def y15_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return fd.correlation(_series(spark, sf), ["pair", "channel"]).select("pair", "channel", F.round("r", 6).alias("r"))


def y16_best_lag(spark: SparkSession, sf: str) -> DataFrame:
    s = _series(spark, sf)
    b = s.select("pair", (F.col("pos") - F.col("pair") % 4).alias("pos"), F.col("a").alias("v"))
    return fd.best_lag(s.select("pair", "pos", F.col("a").alias("v")), b, "pair", 5).select("pair", "lag", F.round("score", 6).alias("score"))


_TRACK = "concat_ws('-', l_linenumber, l_partkey, l_suppkey)"


def y11_track_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order are tracks; some languages and titles go, some tracks with them."""
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", F.expr(_TRACK).alias("pista"), F.expr("CASE l_returnflag WHEN 'A' THEN 'spa' WHEN 'N' THEN 'und' END").alias("language"), F.expr("CASE WHEN l_linestatus = 'F' AND l_partkey % 3 = 0 THEN l_returnflag ELSE '' END").alias("title"))
    after = t.where("l_suppkey % 23 > 0").withColumn("language", F.when(F.col("l_suppkey") % 10 > 0, F.col("language"))).withColumn("title", F.when(F.col("l_suppkey") % 19 == 0, "otro").otherwise(F.col("title")))
    return fd.tags_kept(t, after, "l_orderkey", "pista")


def y12_palette_rules(spark: SparkSession, sf: str) -> DataFrame:
    p, k = y12_p22_palette(spark, sf), F.col("pair")
    target = F.element_at(F.array(*map(F.lit, ("gif", "webp", "avif", "png"))), (k % 4 + 1).cast("int"))
    rules = fd.palette_rules(k % 3 == 0, target, F.when(k % 5 > 0, k % 2 == 0), F.when(k % 7 > 0, F.col("rejilla") | (k % 8 == 0)))
    x = p.select("pair", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), s.alias("severity")) for n, s in rules])).alias("r"))
    return x.where("r.severity is not null").select("pair", "r.rule", "r.severity")


QUERIES = {f.__name__: f for f in (y1_error_rate, y2_phrase_recall, y3_containment, y4_agreement, y5_text_kept, y6_y7_errors, y8_silent_channel, y9_stream_identity, y10_frames, y11_tags, y12_p22_palette, y11_track_tags, y12_palette_rules, y13_fidelity_verdict, y14_five_classes, y15_correlation, y16_best_lag)}

_READ = ("lectura_a", "lectura_b", "ajeno")
_T = "t AS (SELECT doc_id, " + ", ".join(_N10.replace("{x}", c) + f" AS {c}" for c in ("ref", "lectura_a", "lectura_b")) + " FROM v5)"
_S = """s0 AS (SELECT vec_id AS pair, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS a FROM embeddings),
 s AS (SELECT pair, CAST(pos % 2 AS INTEGER) AS channel, CAST(pos AS INTEGER) AS pos, a, CASE WHEN pair % 3 = 0 THEN a WHEN pair % 3 = 1 THEN round(a, 2) WHEN pos % 2 = 1 THEN 0.0::DOUBLE ELSE a END AS b FROM s0)"""
_E = "e AS (SELECT pair, sqrt(avg((a - b) * (a - b))) AS rmse, CASE WHEN avg((a - b) * (a - b)) > 0 THEN 10 * log10(1 / avg((a - b) * (a - b))) END AS psnr, count(*) AS n FROM s GROUP BY pair), e2 AS (SELECT pair, round(rmse, 6) AS rmse, round(psnr, 4) AS psnr, n, CASE WHEN rmse > 0 THEN CASE WHEN psnr < 10 THEN 'fallo' WHEN psnr < CASE WHEN pair % 11 = 0 THEN 0 WHEN pair % 7 = 0 THEN 20 WHEN pair % 5 = 0 THEN 30 ELSE 40 END THEN 'aviso' ELSE 'informativo' END END AS severity FROM e)"
_M = "m AS (SELECT pair, channel, 10 * log10(avg(a * a)) AS in_db, avg(b * b) = 0 AS mudo FROM s GROUP BY pair, channel)"


def _multiset(col: str, split: str) -> str:
    return f"SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest({split.replace('{c}', col)}) AS gram FROM t) GROUP BY doc_id, gram"


_GRAM = "list_transform(range(1, length({c}) - 3), lambda i: substr({c}, i, 5))"
_WORD = "list_filter(string_split({c}, ' '), lambda w: w <> '')"
_OVER = "o AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS common, sum(coalesce(a.n, 0)) AS in_a, sum(coalesce(b.n, 0)) AS in_b FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.gram = b.gram GROUP BY 1)"

ORACLE = {
    "y1_error_rate": oracle("v5 v5_ajeno", ", t AS (SELECT v5.doc_id, " + ", ".join(f"{_N10.replace('{x}', c)} AS {c}" for c in ["ref", *_READ]) + " FROM v5 JOIN v5_ajeno USING (doc_id)), u AS (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS name, ref, {c} AS o FROM t" for c in _READ) + f"""),
 r AS (SELECT doc_id, name, CASE WHEN length(ref) > 0 THEN round(100.0::DOUBLE * levenshtein(ref, o) / length(ref), 6) END AS r FROM u)
SELECT doc_id, """ + ", ".join(f"max(r) FILTER (name = '{c}') AS {c}" for c in _READ) + ", 'acentos plegados' AS metrica FROM r GROUP BY doc_id"),
    "y2_phrase_recall": oracle("v5", f""", {_T}, p AS (SELECT DISTINCT doc_id, unnest([substr(ref, 1, 20), substr(ref, 31, 20)]) AS frase, lectura_b FROM t WHERE length(ref) >= 60),
 d AS (SELECT doc_id, frase, CASE WHEN contains(lectura_b, frase) THEN 0 ELSE list_min(list_transform(range(1, greatest(2, length(lectura_b) - length(frase) + 2)), lambda i: levenshtein(frase, substr(lectura_b, i, length(frase))))) END AS distance FROM p)
SELECT doc_id, frase, CAST(distance AS INTEGER) AS distance, CASE WHEN length(frase) > 0 THEN round(100.0::DOUBLE * greatest(0, length(frase) - distance) / length(frase), 6) ELSE 100.0 END AS similarity FROM d"""),
    "y3_containment": oracle("v5", f", {_T}, a AS ({_multiset('ref', _GRAM)}), b AS ({_multiset('lectura_b', _GRAM)}), {_OVER} SELECT doc_id, round(common / in_a, 6) AS cobertura, CASE WHEN common / in_a < 0.8 THEN 'destruido' WHEN common / in_a < 0.98 THEN 'alterado' ELSE 'integro' END AS clase FROM o WHERE in_a > 0"),
    "y4_agreement": oracle("v5", f", {_T}, a AS ({_multiset('lectura_b', _WORD)}), b AS ({_multiset('ref', _WORD)}), {_OVER} SELECT doc_id, round(2.0::DOUBLE * common / (in_a + in_b), 6) AS acuerdo, CASE WHEN 2.0::DOUBLE * common / (in_a + in_b) >= 0.8 THEN 'reconocido' WHEN 2.0::DOUBLE * common / (in_a + in_b) <= 0.7 THEN 'inventado' ELSE 'indeciso' END AS clase FROM o"),
    "y5_text_kept": oracle("v6", """, w AS (SELECT doc_id, regexp_replace(text, '\\s', '', 'g') AS x, regexp_replace(coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN substr(text, 1, 8) WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'c') ELSE text END, ''), '\\s', '', 'g') AS y FROM v6)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND y = '' THEN 'P5' WHEN length(y) < 10 THEN 'P6' WHEN x <> y THEN 'P2' END AS regla FROM w"""),
    "y6_y7_errors": f"WITH {_S}, {_E} SELECT * FROM e2",
    "y8_silent_channel": f"WITH {_S}, {_M} SELECT pair, channel, round(in_db, 5) AS in_db, mudo, CASE WHEN in_db > -60 AND mudo THEN 'fallo' END AS severity FROM m",
    "y9_stream_identity": f"WITH {_S}, g AS (SELECT pair, count(*) AS n, count(*) FILTER (a <> b) AS other FROM s GROUP BY pair) SELECT g.pair, CASE WHEN g.pair % 4 = 1 THEN CASE WHEN (SELECT count(*) FROM s WHERE s.pair = g.pair AND s.pos >= 3 AND a <> b) = 0 THEN 'recorte' ELSE 'distinto' END WHEN other = 0 THEN 'igual' ELSE 'distinto' END AS result FROM g",
    "y10_frames": f"WITH {_S}, f AS (SELECT pair, pos // 8 AS frame, md5(array_to_string(list(CAST(floor(a * 1000000) AS BIGINT) ORDER BY pos), ',')) AS ha, md5(array_to_string(list(CAST(floor(b * 1000000) AS BIGINT) ORDER BY pos), ',')) AS hb FROM s GROUP BY 1, 2) SELECT pair, count(*) AS frames, count(*) FILTER (ha <> hb) AS distintos, CASE WHEN count(*) FILTER (ha <> hb) > 0 AND pair % 2 = 0 THEN 'fallo' END AS severity FROM f GROUP BY pair",
    "y11_tags": oracle("v11", ", g AS (SELECT coalesce(a.job, b.job) AS job, a.tam AS a, b.tam AS b FROM (SELECT * FROM v11 WHERE fase = 'antes') a FULL JOIN (SELECT * FROM v11 WHERE fase = 'despues') b ON a.job = b.job AND a.nombre = b.nombre), h AS (SELECT job, count(a) AS de_entrada, count(*) FILTER (a IS NOT NULL AND (b IS NULL OR a <> b)) AS perdidas FROM g GROUP BY job) SELECT *, CASE WHEN de_entrada = 0 THEN 'informativo' WHEN perdidas > 0 THEN 'fallo' END AS severity FROM h"),
    "y12_p22_palette": f"WITH {_S}, q AS (SELECT pair, pos // 3 AS px, max(CAST(floor(a * 4) AS INT)) FILTER (pos % 3 = 0) AS r, max(CAST(floor(a * 4) AS INT)) FILTER (pos % 3 = 1) AS g, max(CAST(floor(a * 4) AS INT)) FILTER (pos % 3 = 2) AS b FROM s GROUP BY 1, 2), z AS (SELECT pair, coalesce(r, -99) AS r, coalesce(g, -99) AS g, coalesce(b, -99) AS b FROM q) SELECT pair, count(DISTINCT row(r, g, b)) AS colores, count(DISTINCT r) * count(DISTINCT g) * count(DISTINCT b) = count(DISTINCT row(r, g, b)) AS rejilla FROM z GROUP BY pair",
    "y11_track_tags": f"""WITH t AS (SELECT l_orderkey, l_suppkey, {_TRACK} AS pista, CASE l_returnflag WHEN 'A' THEN 'spa' WHEN 'N' THEN 'und' END AS language, CASE WHEN l_linestatus = 'F' AND l_partkey % 3 = 0 THEN l_returnflag ELSE '' END AS title FROM lineitem),
 x AS (SELECT l_orderkey, unnest([CASE WHEN language = 'spa' AND (l_suppkey % 23 = 0 OR l_suppkey % 10 = 0) THEN pista || ' language' END, CASE WHEN title <> '' AND (l_suppkey % 23 = 0 OR l_suppkey % 19 = 0) THEN pista || ' title' END]) AS l, coalesce(language, '') <> '' OR title <> '' AS alguna FROM t),
 g AS (SELECT l_orderkey, string_agg(l, '; ' ORDER BY l) AS l, bool_or(alguna) AS alguna FROM x GROUP BY 1) SELECT l_orderkey, CASE WHEN l IS NOT NULL THEN 'aviso' ELSE 'informativo' END AS severity, CASE WHEN l IS NOT NULL THEN l WHEN NOT alguna THEN 'sin etiquetas' END AS lost FROM g""",
    "y12_palette_rules": f"WITH p AS (WITH {_S}, q AS (SELECT pair, pos // 3 AS px, max(CAST(floor(a * 4) AS INT)) FILTER (pos % 3 = 0) AS r, max(CAST(floor(a * 4) AS INT)) FILTER (pos % 3 = 1) AS g, max(CAST(floor(a * 4) AS INT)) FILTER (pos % 3 = 2) AS b FROM s GROUP BY 1, 2), z AS (SELECT pair, coalesce(r, -99) AS r, coalesce(g, -99) AS g, coalesce(b, -99) AS b FROM q) SELECT pair, count(DISTINCT row(r, g, b)) AS colores, count(DISTINCT r) * count(DISTINCT g) * count(DISTINCT b) = count(DISTINCT row(r, g, b)) AS rejilla FROM z GROUP BY pair), r AS (SELECT pair, 'I8' AS rule, CASE WHEN pair % 3 = 0 AND pair % 4 IN (1, 2) AND (pair % 5 = 0 OR pair % 2 = 0) THEN 'aviso' END AS severity FROM p UNION ALL SELECT pair, 'V9', CASE WHEN pair % 4 = 0 AND pair % 7 > 0 THEN CASE WHEN rejilla OR pair % 8 = 0 THEN 'aviso' ELSE 'informativo' END END FROM p) SELECT * FROM r WHERE severity IS NOT NULL",
    "y13_fidelity_verdict": f"WITH {_S}, {_E}, {_M}, k AS (SELECT pair, bool_or(in_db > -60 AND mudo) AS mudo FROM m GROUP BY pair) SELECT e2.pair, CASE WHEN coalesce(severity = 'fallo', false) OR k.mudo THEN 'fallo' WHEN severity = 'aviso' THEN 'aviso' WHEN e2.pair % 4 > 0 THEN 'ok' ELSE 'ok_parcial' END AS verdict FROM e2 JOIN k ON e2.pair = k.pair",
    "y14_five_classes": oracle("v3", ", r AS (SELECT l_orderkey, CASE WHEN sr_sal <> sr_ent THEN CASE WHEN destino = 'jpg' THEN 1 ELSE 3 END WHEN prof_sal < prof_ent THEN CASE WHEN destino = 'jpg' THEN 1 ELSE 2 END WHEN l_partkey % 50 = 0 THEN 4 ELSE 0 END AS k FROM v3) SELECT l_orderkey, ['ÍNTEGRO', 'PÉRDIDA INEVITABLE', 'DEGRADADO', 'DESTRUIDO', 'FALLO'][max(k) + 1] AS class FROM r GROUP BY l_orderkey"),
    "y15_correlation": f"WITH {_S} SELECT pair, channel, round(CASE WHEN min(a) = max(a) OR min(b) = max(b) THEN 0 ELSE corr(a, b) END, 6) AS r FROM s GROUP BY pair, channel",
    "y16_best_lag": f"WITH {_S}, x AS (SELECT s.pair, CAST(l.lag AS INTEGER) AS lag, sum(s.a * t.a) AS score FROM s CROSS JOIN (SELECT unnest(range(-5, 6)) AS lag) l JOIN s t ON t.pair = s.pair AND t.pos - t.pair % 4 = s.pos + l.lag GROUP BY ALL) SELECT pair, lag, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(score, 9) DESC, lag) AS r FROM x) WHERE r = 1",
}
