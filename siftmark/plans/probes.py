"""Queries of the contract over whole probes: an order is a file, its lines are the tracks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contract as ct
from ..operators import probes as pr
from ..views import oracle, view


def probe_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(job, entrada, salida, pedido) of V13 and V14."""
    t = view(spark, sf, "v13")
    track = F.struct(*[F.col(c.split(":")[0]).cast(c.split(":")[1]).alias(c.split(":")[0]) for c in pr.TRACK.removeprefix("struct<").removesuffix(">").split(",")])
    of = t.groupBy("job").agg(F.sort_array(F.collect_list(F.struct("lado", "orden", track.alias("p")))).alias("todas"))
    of = of.select("job", *[F.transform(F.filter("todas", lambda s: s["lado"] == side), lambda s: s["p"]).alias(f"pistas_{side}") for side in ("entrada", "salida")])
    f = view(spark, sf, "v14").join(of, "job", "left")
    none = F.array().cast(f"array<{pr.TRACK}>")
    probe = lambda side, e: F.struct(*[F.col(f"{c}_{e}").alias(c) for c in ("categoria", "ancho", "alto", "bits", "alfa", "alfa_min", "dur", "ppp", "ancho_pt", "paginas", "comprimido", "bitrate_bps")], F.coalesce(f"pistas_{side}", none).alias("pistas")).cast(pr.PROBE)
    flows = F.when(F.col("pide_flujos"), F.struct(F.lit(1).alias("video"), F.lit(1).alias("audio"), F.lit(None).cast("int").alias("subtitulo")))
    none_asked = [F.col(c) for c in ("solo_audio", "solo_video", "recortar", "pide_ancho", "pide_alto", "dpi", "pide_bits", "fps", "pide_sr", "pide_canales", "pide_video_bps", "pide_bps")]
    pedido = F.struct(F.col("destino"), flows.alias("flujos"), *none_asked)
    return f.select("job", probe("entrada", "ent").alias("entrada"), probe("salida", "sal").alias("salida"), pedido.cast(pr.ASKED).alias("pedido"))


def c4_c14_probes(spark: SparkSession, sf: str) -> DataFrame:
    rules = [r._replace(expected=F.lit(None), obtained=F.lit(None)) for r in pr.media_rules()]  # neither is shown
    return ct.findings(pr.prepared(probe_pairs(spark, sf)), ["job"], rules).select("job", "point", "rule", "severity")


def c23_probe_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict of each whole probe; covered if there was an input of the same kind to compare with."""
    same = F.coalesce(F.col("entrada.categoria") == F.col("salida.categoria"), F.lit(False))
    return ct.verdicts(pr.prepared(probe_pairs(spark, sf)), pr.media_rules(), ["job"], same)


QUERIES = {f.__name__: f for f in (c4_c14_probes, c23_probe_verdict)}

_FIRST = lambda side, kind, x: f"arg_min({x}, orden) FILTER (lado = '{side}' AND tipo = '{kind}' AND {x} <> 0) AS {kind}_{x}_{side[:3]}"
_N = lambda side, kind: f"count(*) FILTER (lado = '{side}' AND tipo = '{kind}') AS n_{kind}_{side[:3]}"
_FRAME = "CASE codec WHEN 'mp3' THEN 1152 WHEN 'aac' THEN 1024 WHEN 'opus' THEN 960 WHEN 'libopus' THEN 960 END / CASE WHEN sample_rate > 0 THEN sample_rate ELSE 48000 END::DOUBLE"
_AV, _IMG, _PDF = "categoria_sal = 'av'", "categoria_sal = 'imagen'", "categoria_sal = 'pdf'"
_BOTH = "categoria_ent = 'imagen' AND categoria_sal = 'imagen'"
_RULES = [
    (2, "V3-sin", f"{_AV} AND NOT pide_flujos AND coalesce(categoria_ent, '') <> 'av'", "'informativo'"),
    *[(2, name, _AV, f"CASE WHEN n_{k}_sal < espera_{k} THEN 'fallo' WHEN n_{k}_sal > espera_{k} THEN 'aviso' END") for k, name in pr.KINDS.items()],
    (3, "G4-size", _IMG, "CASE WHEN coalesce(ancho_sal, 0) = 0 OR coalesce(alto_sal, 0) = 0 THEN 'fallo' WHEN ancho_sal < 2 OR alto_sal < 2 THEN 'aviso' END"),
    (3, "G4-depth", f"{_IMG} AND bits_sal NOT IN (1, 2, 4, 8, 10, 12, 16, 32)", "'aviso'"),
    (3, "G4-duration", f"{_AV} AND coalesce(dur_sal, 0) <= 0", "'fallo'"),
    (3, "G4-tracks", f"{_AV} AND n_sal = 0", "'fallo'"),
    (3, "A2-none", f"{_AV} AND sin_canales > 0", "'aviso'"),
    (3, "A3-odd", f"{_AV} AND raras > 0", "'aviso'"),
    (3, "V7-size", f"{_AV} AND sin_tamano > 0", "'fallo'"),
    (3, "G4-rate", f"{_AV} AND bitrate_bps_sal <= 0", "'aviso'"),
    (3, "P1-pages", f"{_PDF} AND coalesce(paginas_sal, 0) = 0", "CASE WHEN comprimido_sal THEN 'aviso' ELSE 'fallo' END"),
    (4, "I1/V7", "NOT geom AND coalesce(categoria_ent, '') <> 'pdf' AND (w <> w0 OR h <> h0)", "'fallo'"),
    (4, "I1", "pide_ancho > 0 AND (w <> pide_ancho OR (pide_alto > 0 AND h <> pide_alto))", "'fallo'"),
    (4, "I1-aspect", "NOT geom AND NOT recortar AND abs(w / h - w0 / h0) > 0.02", "'aviso'"),
    (4, "P4-dpi", f"{_IMG} AND ppp_sal > 0 AND abs(ppp_sal - dpi) > 1", "'fallo'"),
    (4, "P4-px", f"categoria_ent = 'pdf' AND {_IMG} AND abs(w - round(ancho_pt_ent * dpi / 72.0)) > 1", "'fallo'"),
    (4, "I5", f"{_BOTH} AND b < b0 AND coalesce(pide_bits <> b, true)", "CASE WHEN b <= CASE WHEN destino IN ('jpg', 'webp', 'gif') THEN 8 END THEN 'informativo' ELSE 'fallo' END"),
    (4, "A6", f"{_AV} AND b > b0 AND sin_perdida > 0", "'aviso'"),
    (4, "I2", f"{_BOTH} AND alfa_ent AND NOT coalesce(alfa_sal, false)", "CASE WHEN alfa_min_ent IS NULL THEN 'informativo' WHEN alfa_min_ent < 255 THEN CASE WHEN destino = 'jpg' THEN 'informativo' ELSE 'fallo' END END"),
    (4, "A1/V1", "d > 0 AND d0 > 0 AND NOT recortar AND fps IS NULL AND abs(d - d0) > CASE WHEN n_video_sal > 0 THEN 0.050::DOUBLE ELSE greatest(0.010::DOUBLE, coalesce(trama, 0)) END", "'fallo'"),
    (4, "A3", "pide_sr IS NULL AND audio_sample_rate_sal <> audio_sample_rate_ent", "CASE WHEN contains(lower(codec_sal), 'opus') AND audio_sample_rate_sal = 48000 THEN 'informativo' ELSE 'fallo' END"),
    (4, "A2", "pide_canales IS NULL AND audio_canales_sal <> audio_canales_ent", "'fallo'"),
    (4, "V10", "n_video_sal > 0", "CASE WHEN (bitrate_bps_sal - pide_video_bps) / pide_video_bps < -0.60 THEN 'fallo' WHEN (bitrate_bps_sal - pide_video_bps) / pide_video_bps > 0.60 THEN CASE WHEN n_audio_sal = 0 THEN 'fallo' ELSE 'informativo' END END"),
    (4, "A-rate", "true", "CASE WHEN abs(audio_bitrate_bps_sal - pide_bps) / pide_bps > 0.50 THEN 'fallo' WHEN abs(audio_bitrate_bps_sal - pide_bps) / pide_bps > 0.15 THEN 'aviso' END"),
    (4, "P7-box", f"{_PDF} AND categoria_ent = 'imagen' AND abs(ancho_pt_sal - w0 * 72.0 / dpi) > 1.5", "'fallo'"),
    (4, "P7", f"{_PDF} AND categoria_ent = 'imagen' AND dpi IS NULL AND abs(ancho_pt_sal - w0) < 1.0 AND w0 > 1000", "'aviso'"),
    (4, "P1", f"{_PDF} AND categoria_ent = 'pdf' AND paginas_ent > 0 AND paginas_sal > 0 AND paginas_ent <> paginas_sal", "'fallo'"),
]
_FACTS = f""", t AS (SELECT job, {", ".join(_FIRST(s, "audio", x) for s in ("entrada", "salida") for x in ("sample_rate", "canales", "dur", "bitrate_bps"))}, {", ".join(_N(s, k) for s in ("entrada", "salida") for k in pr.KINDS)},
  count(*) FILTER (lado = 'salida') AS n_sal, count(*) FILTER (lado = 'salida' AND tipo = 'audio' AND coalesce(canales, 0) = 0) AS sin_canales, count(*) FILTER (lado = 'salida' AND tipo = 'audio' AND sample_rate > 0 AND sample_rate NOT BETWEEN 8000 AND 192000) AS raras,
  count(*) FILTER (lado = 'salida' AND tipo = 'video' AND (coalesce(ancho, 0) = 0 OR coalesce(alto, 0) = 0)) AS sin_tamano, count(*) FILTER (lado = 'salida' AND tipo = 'audio' AND codec IN ('flac', 'tta')) AS sin_perdida,
  arg_min(codec, orden) FILTER (lado = 'salida' AND tipo = 'audio' AND sample_rate > 0) AS codec_sal, max({_FRAME}) FILTER (tipo = 'audio') AS trama,
  arg_min(bits, orden) FILTER (lado = 'entrada' AND bits > 0) AS tb0, arg_min(bits, orden) FILTER (lado = 'salida' AND bits > 0) AS tb,
  arg_min(ancho, orden) FILTER (lado = 'entrada' AND tipo = 'video' AND ancho > 0) AS tw0, arg_min(alto, orden) FILTER (lado = 'entrada' AND tipo = 'video' AND ancho > 0) AS th0,
  arg_min(ancho, orden) FILTER (lado = 'salida' AND tipo = 'video' AND ancho > 0) AS tw, arg_min(alto, orden) FILTER (lado = 'salida' AND tipo = 'video' AND ancho > 0) AS th FROM v13 GROUP BY job),
 z AS (SELECT v14.*, t.* EXCLUDE (job, n_sal, {", ".join(f"n_{k}_{s}" for k in pr.KINDS for s in ("ent", "sal"))}, sin_canales, raras, sin_tamano, sin_perdida), {", ".join(f"coalesce({c}, 0) AS {c}" for c in ["n_sal", *[f"n_{k}_{s}" for k in pr.KINDS for s in ("ent", "sal")], "sin_canales", "raras", "sin_tamano", "sin_perdida"])} FROM v14 LEFT JOIN t ON t.job = v14.job),
 x AS (SELECT *, pide_ancho IS NOT NULL OR pide_alto IS NOT NULL OR dpi IS NOT NULL AS geom, CASE WHEN ancho_sal > 0 THEN ancho_sal ELSE tw END AS w, CASE WHEN ancho_sal > 0 THEN alto_sal ELSE th END AS h, CASE WHEN ancho_ent > 0 THEN ancho_ent ELSE tw0 END AS w0, CASE WHEN ancho_ent > 0 THEN alto_ent ELSE th0 END AS h0,
  coalesce(CASE WHEN bits_ent > 0 THEN bits_ent END, tb0) AS b0, coalesce(CASE WHEN bits_sal > 0 THEN bits_sal END, tb) AS b, CASE WHEN solo_audio THEN coalesce(audio_dur_ent, dur_ent) ELSE dur_ent END AS d0, CASE WHEN solo_audio THEN coalesce(audio_dur_sal, dur_sal) ELSE dur_sal END AS d,
  {", ".join(f"CASE WHEN pide_flujos THEN {0 if k == 'subtitulo' else 1} WHEN categoria_ent = 'av' THEN CASE WHEN solo_video THEN {'n_video_ent' if k == 'video' else 0} WHEN solo_audio THEN {1 if k == 'audio' else 0} WHEN destino = 'gif' THEN {1 if k == 'video' else 0} ELSE n_{k}_ent END END AS espera_{k}" for k in pr.KINDS)} FROM z),
 f AS ({" UNION ALL ".join(f"SELECT job, {point} AS point, '{name}' AS rule, {severity} AS severity FROM x WHERE {when}" for point, name, when, severity in _RULES)})
"""
_MEDIA = oracle("v13 v14", _FACTS)
ORACLE = {
    "c4_c14_probes": _MEDIA + "SELECT * FROM f WHERE severity IS NOT NULL",
    "c23_probe_verdict": _MEDIA + "SELECT v14.job, CASE WHEN max(CASE severity WHEN 'fallo' THEN 2 WHEN 'aviso' THEN 1 END) = 2 THEN 'fallo' WHEN max(CASE severity WHEN 'fallo' THEN 2 WHEN 'aviso' THEN 1 END) = 1 THEN 'aviso' WHEN coalesce(any_value(categoria_ent = categoria_sal), false) THEN 'ok' ELSE 'ok_parcial' END AS verdict FROM v14 LEFT JOIN f ON f.job = v14.job GROUP BY v14.job",
}
