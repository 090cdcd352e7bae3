"""Queries of single-row operators: names, texts, probes, costs; and of the simple stores."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import formats as fm
from ..functions import media, stats, text
from ..functions import signatures as sg
from ..views import oracle, table, view

A, P = text.ACCENTED, text.PLAIN
_NORM = {
    "n00": f"trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9{A} ]+', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))",
    "n01": "trim(regexp_replace(lower(x), '[ \\t\\r\\n]+', ' ', 'g'))",
    "n10": f"trim(regexp_replace(regexp_replace(translate(lower(x), '{A}', '{P}'), '[^a-z0-9 ]+', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))",
    "n11": f"trim(regexp_replace(translate(lower(x), '{A}', '{P}'), '[ \\t\\r\\n]+', ' ', 'g'))",
}
_EXT = "regexp_extract(name, '[^./]\\.([^./]+)$', 1)"
_NEXT = f"CASE lower({_EXT}) WHEN 'jpeg' THEN 'jpg' WHEN 'tiff' THEN 'tif' WHEN 'htm' THEN 'html' WHEN 'markdown' THEN 'md' ELSE lower({_EXT}) END"


def p1_extension(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v1").select("name", fm.normal_extension(fm.extension(F.col("name"))).alias("ext"))


def p2_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "v1").select("name", fm.normal_extension(fm.extension(F.col("name"))).alias("ext"))
    return files.join(F.broadcast(fm.formats(spark)), "ext", "left").select("name", "ext", "categoria", "texto", "alfa", "prof_max", "perdida")


def p4_text_type(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v1").select("name", sg.text_type(F.col("body")).alias("tipo"))


_SPECIMENS = [
    "", *[(b"-" * m.offset + m.bytes).hex().upper() for m in sg.MARKS], *[(b"RIFF\xff\0\0\0" + x.encode()).hex().upper() for x in (*sg.RIFF, "XXXX")], *[(b"FORM\0\0\0\0" + x.encode()).hex().upper() for x in (*sg.FORM, "ILBM")],
    *[(b"\0\0\0\x1cftyp" + x.encode()).hex().upper() for x in (*sg.BRANDS, "none")], *[(b"title".ljust(60, b"\0") + x.encode()).hex().upper() for x in sg.PALM],
    *[(b"PK\x03\x04".ljust(30, b"\0") + b"mimetype" + x.encode()).hex().upper() for x in (*sg.ZIP_MIME, "text/plain")], *[(b"PK\x03\x04".ljust(30, b"\0") + x.encode()).hex().upper() for x in (*sg.ZIP_MEMBERS, "other/")],
    *[x.hex().upper() for x in (sg.CFB, sg.WAVE64, b"RF64", b"P6\n", b"P7 ", b"Pf\n", b"\x0a\x05\x00\x08", b"G".ljust(188, b"\1") + b"G", b"\1\1\1\1G".ljust(196, b"\1") + b"G", b"\0\0\0\1\x67", b"\0\0\1\x09", b"\xff\xf1\x50", b"\xff\xfb\x90", b"MM\x06\0\0\0", b"\0\1\2", b"RIFF", b"\xef\xbb\xbf \t%!PS", b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR\0\0\x02\x80\0\0\x01\xe0")],
]


def _specimens(spark: SparkSession, sf: str) -> DataFrame:
    """The files of V1, each behind one of the headers that the tables tell apart, by its place in the alphabet of digests."""
    pick = F.expr(f"cast(conv(substr(md5(name), 1, 8), 16, 10) as bigint) % {len(_SPECIMENS)}").cast("int")
    head = F.element_at(F.array(*map(F.lit, _SPECIMENS)), pick + 1)
    return view(spark, sf, "v1").select("name", head.alias("head"), F.concat(F.unhex(head), F.coalesce("body", F.lit("")).cast("binary")).alias("content"))


def p3_signature(spark: SparkSession, sf: str) -> DataFrame:
    """Type by bytes, and P6 to P8 and P18 beside it, of every file of the corpus behind one of the headers."""
    kind = fm.normal_extension(fm.extension(F.col("name")))
    files = _specimens(spark, sf).select("name", "content", sg.signature(F.col("content")).alias("tipo"), kind.alias("ext"))
    tipo = F.col("tipo")
    return files.select("name", "tipo", sg.probe_category(tipo).alias("sonda"), fm.coherent(tipo, F.col("ext")).alias("coherente"), fm.declared_length_status(F.col("content")).alias("completo"), F.round(fm.png_megapixels(F.col("content")), 6).alias("mpx"))


def p5_signature_status(spark: SparkSession, sf: str) -> DataFrame:
    ext = fm.normal_extension(fm.extension(F.col("name")))
    return view(spark, sf, "v1").select("name", fm.signature_status(ext).alias("estado"))


def p7_coherent(spark: SparkSession, sf: str) -> DataFrame:
    ext = fm.normal_extension(fm.extension(F.col("name")))
    return view(spark, sf, "v1").select("name", fm.coherent(sg.text_type(F.col("body")), ext).alias("coherente"))


def p9_safe_name(spark: SparkSession, sf: str) -> DataFrame:
    name = F.substring(F.col("body"), 1, 12)
    return view(spark, sf, "v1").select("name", fm.safe_name(name).alias("seguro"), fm.safe_name(F.concat(F.lit("con."), name)).alias("dispositivo"))


def p10_codec(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("l_linenumber") == 1, "A_AAC").when(F.col("l_linenumber") == 2, "libopus").when(F.col("l_linenumber") == 3, "mp4a").when(F.col("l_linenumber") == 4, "V_MPEG4/ISO/AVC").otherwise(F.col("destino"))
    return view(spark, sf, "v3").select("l_orderkey", "l_linenumber", media.codec(name).alias("codec"))


def p11_rate(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat((F.col("l_partkey") % 4000).cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "k").when(F.col("l_linenumber") % 3 == 1, "M").otherwise(" bps"))
    return view(spark, sf, "v3").select("l_orderkey", "l_linenumber", media.bits_per_second(said).alias("bps"))


def p12_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    tracks = F.array(F.struct(F.col("destino").alias("codec"), F.col("sr_ent").alias("sample_rate")), F.struct(F.lit("A_AAC").alias("codec"), F.col("sr_sal").alias("sample_rate")))
    return view(spark, sf, "v3").select("l_orderkey", "l_linenumber", F.round(media.duration_tolerance(tracks, F.col("n_audio") == 0), 6).alias("tol"))


def p13_effective_rate(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v3")
    declared = F.when(F.col("l_linenumber") % 2 == 0, F.col("obtenido_bps"))
    return v.select("l_orderkey", "l_linenumber", F.round(media.effective_rate(declared, F.col("l_partkey") * 1000, F.col("dur_ent"), F.col("n_audio") == 2), 3).alias("tasa"))


def p14_normalisations(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("ref")
    return view(spark, sf, "v5").select("doc_id", text.normal(x).alias("n00"), text.normal(x, keep_punctuation=True).alias("n01"), text.normal(x, fold=True).alias("n10"), text.normal(x, True, True).alias("n11"))


def p15_character_census(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.count_of(F.col("text"), A).alias("acentos"), text.count_of(F.col("text"), text.PUNCTUATION).alias("puntuacion"), F.length("text").alias("n"))


def p16_token_signals(spark: SparkSession, sf: str) -> DataFrame:
    said = text.token_signals(F.col("text"))
    exact = ("tokens", "sospecha")
    return table(spark, sf, "documents").select("doc_id", *[(c if k in exact else F.round(c, 6)).alias(k) for k, c in said.items()])


def p17_collapse(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v5").withColumn("ref", text.normal(F.col("ref"), fold=True)).withColumn("sal", F.expr("substr(ref, CAST(doc_id % 7 AS INT) + 1, CAST(doc_id % 4 * 120 AS INT))"))
    v = v.withColumn("cer", text.error_rate(F.col("ref"), F.col("sal")))
    return v.select("doc_id", F.round("cer", 6).alias("cer"), text.collapse_class(F.col("cer"), F.length("sal"), F.length("ref") / 2).alias("clase"))


def _lines(v: DataFrame) -> DataFrame:
    return v.withColumn("mpx", F.col("l_partkey") % 400 / 10.0).withColumn("base", F.lit(428.0)).withColumn("slope", F.lit(235.0)).withColumn("cap", F.lit(1533.0)).withColumn("libre", F.when(F.col("l_linenumber") < 7, F.col("l_partkey") % 20 * 100.0)).withColumn("residente", F.col("l_linenumber") * 150.0)


def p19_cost_line(spark: SparkSession, sf: str) -> DataFrame:
    v, c = _lines(view(spark, sf, "v3")), F.col
    most = stats.largest_admissible(c("libre"), F.lit(256.0), c("base"), c("slope"), c("cap"))
    return v.select("l_orderkey", "l_linenumber", F.round(stats.cost(c("mpx"), c("base"), c("slope"), c("cap")), 6).alias("coste"), F.round(F.when(most == float("inf"), -1.0).otherwise(most), 6).alias("mpx_max"))


def p20_admission(spark: SparkSession, sf: str) -> DataFrame:
    v, c = _lines(view(spark, sf, "v3")), F.col
    return v.select("l_orderkey", "l_linenumber", stats.admission(stats.cost(c("mpx"), c("base"), c("slope"), c("cap")), c("libre"), F.lit(256.0), c("residente")).alias("decision"))


def p21_budget(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v8").withColumn("suma", F.round(F.col("metrica_a") * 100 + F.col("metrica_b") * 100, 7)).withColumn("medido", F.when(F.col("n") % 2 == 0, F.round(F.col("metrica_a") * 190, 7)))
    total = F.coalesce("medido", "suma")
    return v.select("ajuste", "doc", total.alias("total"), (total <= 950).alias("cumple_techo"), (total <= 1000).alias("cabe"), F.col("medido").isNull().alias("supuesta"))


def s7_last_pass(spark: SparkSession, sf: str) -> DataFrame:
    """One result a cell, the latest pass; cells without output are set aside and counted."""
    v = view(spark, sf, "v3")
    last = Window.partitionBy("l_partkey", "destino").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"))
    kept = v.withColumn("r", F.row_number().over(last)).where("r = 1").withColumn("vacia", F.col("prof_ent") == 16)
    return kept.groupBy("destino").agg(F.count_if(~F.col("vacia")).alias("celdas"), F.count_if("vacia").alias("apartadas"), F.round(F.sum(F.when(~F.col("vacia"), F.col("obtenido_bps"))), 3).alias("bps"))


def s9_job_store(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "v12")
    return v.groupBy("job").agg(F.max_by("estado", F.struct("ts", "event_id")).alias("estado"), F.count("*").alias("eventos"))


QUERIES = {f.__name__: f for f in (p1_extension, p2_capabilities, p3_signature, p4_text_type, p5_signature_status, p7_coherent, p9_safe_name, p10_codec, p11_rate, p12_tolerance, p13_effective_rate, p14_normalisations, p15_character_census, p16_token_signals, p17_collapse, p19_cost_line, p20_admission, p21_budget, s7_last_pass, s9_job_store)}

_FORMATS = ", ".join(f"('{e}', '{c}', {e in fm.HOLDS_TEXT}, {e in fm.HOLDS_ALPHA}, {fm.DEPTH.get(e, 8)}, {e in fm.LOSSY})" for e, c in fm.spread(fm.CATEGORY).items())
_TYPE = """CASE WHEN regexp_matches(b, '^%!PS') THEN 'postscript' WHEN starts_with(b, '%PDF-') THEN 'pdf' WHEN starts_with(b, 'WEBVTT') THEN 'vtt' WHEN starts_with(b, '#define ') THEN 'xbm' WHEN starts_with(b, 'solid ') THEN 'stl_ascii'
 WHEN starts_with(lower(b), '<?xml') THEN CASE WHEN contains(lower(substr(b, 1, 600)), '<svg') THEN 'svg' WHEN contains(lower(substr(b, 1, 600)), '<html') THEN 'html' ELSE 'xml' END
 WHEN starts_with(lower(b), '<!doctype html') OR starts_with(lower(b), '<html') THEN 'html' WHEN starts_with(lower(b), '<svg') THEN 'svg' ELSE 'texto' END"""
_B = "(SELECT name, ltrim(body, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS b FROM v1)"
_SAFE = """coalesce({x} <> '' AND {x} NOT IN ('.', '..') AND NOT regexp_matches({x}, '[/\\\\:]') AND NOT regexp_matches({x}, '[. ]$') AND NOT upper(split_part({x}, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') AND NOT regexp_full_match(upper(split_part({x}, '.', 1)), '(COM|LPT)[1-9]'), false)"""
_W = "list_filter(string_split(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' '), lambda w: w <> '')"
_MPX = "least(428.0 + 235.0 * (l_partkey % 400 / 10.0), 1533.0)"
_FREE = "CASE WHEN l_linenumber < 7 THEN l_partkey % 20 * 100.0 END"

_HEX = lambda x: f"'{x.hex().upper() if isinstance(x, bytes) else x.encode().hex().upper()}'"
_CASES = lambda x, pairs: f"CASE {x} " + " ".join(f"WHEN {_HEX(k)} THEN '{v}'" for k, v in pairs.items())
_STARTS = lambda x, pairs: " ".join(f"WHEN starts_with({x}, {_HEX(k)}) THEN '{v}'" for k, v in pairs)
_LOW = "lower(decode(unhex(regexp_replace(substr(regexp_replace(substr(h, 1, 1024), '^(EFBBBF)?((20|09|0D|0A))*', ''), 1, 1200), '([0-7].)|(..)', '\\1', 'g'))))"
_P3 = f"""SELECT name, tipo, CASE {" ".join(f"WHEN tipo IN ({', '.join(repr(k) for k in ks)}) THEN '{c}'" for c, ks in sg.PROBE.items())} END AS sonda,
 CASE ext {" ".join(f"WHEN '{e}' THEN tipo IN ({', '.join(repr(k) for k in fm.ACCEPTED[e])})" for e in ("html", "txt", "md"))} END AS coherente,
 CASE WHEN n < 12 THEN 'incompleto' WHEN starts_with(h, {_HEX("RIFF")}) THEN CASE WHEN riff IN (0, 4294967295) THEN 'sin_declaracion' WHEN n >= riff + 8 THEN 'completo' ELSE 'incompleto' END
  WHEN starts_with(h, {_HEX(sg.MARKS[0].bytes)}) THEN CASE WHEN substr(h, -16, 8) = {_HEX("IEND")} THEN 'completo' ELSE 'incompleto' END ELSE 'sin_declaracion' END AS completo,
 CASE WHEN starts_with(h, {_HEX(sg.MARKS[0].bytes)}) THEN round(CAST('0x' || substr(h, 33, 8) AS BIGINT) * CAST('0x' || substr(h, 41, 8) AS BIGINT) / 1e6, 6)::DOUBLE END AS mpx
FROM (SELECT *, CASE WHEN h = '' THEN 'vacio' WHEN starts_with(h, {_HEX("RIFF")}) AND n >= 12 THEN {_CASES("substr(h, 17, 8)", sg.RIFF)} ELSE 'riff' END WHEN starts_with(h, {_HEX("RF64")}) THEN 'wav' WHEN starts_with(h, {_HEX(sg.WAVE64)}) THEN 'wave64'
  WHEN starts_with(h, {_HEX("FORM")}) AND n >= 12 THEN {_CASES("substr(h, 17, 8)", sg.FORM)} ELSE 'iff' END WHEN substr(h, 9, 8) = {_HEX("ftyp")} AND n >= 12 THEN {_CASES("substr(h, 17, 8)", sg.BRANDS)} ELSE 'isobmff' END
  WHEN starts_with(h, '504B0304') THEN CASE WHEN substr(h, 61, 16) = {_HEX("mimetype")} AND EXISTS (SELECT 1 FROM (VALUES {", ".join(f"({_HEX(k)})" for k in sg.ZIP_MIME)}) z(m) WHERE starts_with(substr(h, 77), m)) THEN CASE {_STARTS("substr(h, 77)", sg.ZIP_MIME.items())} END
   {_STARTS("substr(h, 61)", sg.ZIP_MEMBERS.items())} ELSE 'zip' END
  WHEN starts_with(h, {_HEX(sg.CFB)}) THEN 'cfb' ELSE coalesce({_CASES("substr(h, 121, 16)", sg.PALM)} END, mark, CASE WHEN starts_with(h, '4D4D') AND n >= 6 AND CAST('0x' || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) AS BIGINT) = n THEN '3ds'
   {" ".join(f"WHEN regexp_matches(substr(h, 1, 400), '{p}') THEN '{k}'" for p, k in sg.PATTERNS)}
   WHEN NOT regexp_full_match(substr(h, 1, 1024), '(([2-9A-F].)|09|0A|0D)*') THEN 'desconocido' {_STARTS("regexp_replace(substr(h, 1, 1024), '^(EFBBBF)?((20|09|0D|0A))*', '')", sg.TEXT_MARKS)}
   WHEN starts_with(low, '<?xml') THEN CASE WHEN contains(low, '<svg') THEN 'svg' WHEN contains(low, '<html') OR contains(low, '<!doctype html') THEN 'html' ELSE 'xml' END
   WHEN starts_with(low, '<!doctype html') OR starts_with(low, '<html') THEN 'html' WHEN starts_with(low, '<svg') THEN 'svg' ELSE 'texto' END) END AS tipo
 FROM (SELECT *, {_LOW} AS low, CASE WHEN n >= 8 THEN CAST('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) AS BIGINT) END AS riff FROM b) x) y"""
_P3 = f""", s AS (SELECT list_value({", ".join(f"'{x}'" for x in _SPECIMENS)}) AS all_), m(rank, pos, mark, kind) AS (VALUES {", ".join(f"({i}, {2 * m.offset + 1}, '{m.bytes.hex().upper()}', '{m.kind}')" for i, m in enumerate(sg.MARKS))}),
a AS (SELECT name, {_NEXT} AS ext, all_[CAST('0x' || substr(md5(name), 1, 8) AS BIGINT) % {len(_SPECIMENS)} + 1] || hex(encode(coalesce(body, ''))) AS h FROM v1, s),
k AS (SELECT name, arg_min(kind, rank) AS mark FROM a, m WHERE substr(h, pos, length(m.mark)) = m.mark GROUP BY name),
b AS (SELECT a.*, k.mark, length(h) // 2 AS n FROM a LEFT JOIN k ON k.name = a.name)
{_P3}"""

ORACLE = {
    "p3_signature": oracle("v1", _P3),
    "p1_extension": oracle("v1", f"SELECT name, {_NEXT} AS ext FROM v1"),
    "p2_capabilities": oracle("v1", f"SELECT x.name, x.ext, f.categoria, f.texto, f.alfa, CAST(f.prof_max AS INTEGER) AS prof_max, f.perdida FROM (SELECT name, {_NEXT} AS ext FROM v1) x LEFT JOIN (VALUES {_FORMATS}) f(ext, categoria, texto, alfa, prof_max, perdida) ON x.ext = f.ext"),
    "p4_text_type": oracle("v1", f"SELECT name, {_TYPE} AS tipo FROM {_B}"),
    "p5_signature_status": oracle("v1", f"SELECT name, CASE {_NEXT} WHEN 'html' THEN 'familia' WHEN 'txt' THEN 'familia' WHEN 'md' THEN 'familia' ELSE 'sin_vocabulario' END AS estado FROM v1"),
    "p7_coherent": oracle("v1", f"SELECT name, CASE WHEN {_NEXT} = 'html' THEN {_TYPE} IN ('html', 'xml', 'texto') WHEN {_NEXT} IN ('txt', 'md') THEN {_TYPE} IN ('texto', 'im_texto') END AS coherente FROM {_B}"),
    "p9_safe_name": oracle("v1", f"SELECT name, {_SAFE.format(x='s')} AS seguro, {_SAFE.format(x='t')} AS dispositivo FROM (SELECT name, substr(body, 1, 12) AS s, concat('con.', substr(body, 1, 12)) AS t FROM v1)"),
    "p10_codec": oracle("v3", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'aac' WHEN 2 THEN 'opus' WHEN 3 THEN 'aac' WHEN 4 THEN 'h264' ELSE destino END AS codec FROM v3"),
    "p11_rate": oracle("v3", "SELECT l_orderkey, l_linenumber, CAST((l_partkey % 4000) * CASE l_linenumber % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END AS BIGINT) AS bps FROM v3"),
    "p12_tolerance": oracle("v3", "SELECT l_orderkey, l_linenumber, round(greatest(0.010, CASE WHEN destino = 'opus' THEN 960.0 / sr_ent ELSE 0 END, 1024.0 / sr_sal, CASE WHEN n_audio = 0 THEN 0.050 ELSE 0 END), 6)::DOUBLE AS tol FROM v3"),
    "p13_effective_rate": oracle("v3", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 2 = 0 THEN obtenido_bps WHEN n_audio <> 2 AND dur_ent > 0 THEN 8.0 * l_partkey * 1000 / dur_ent END, 3) AS tasa FROM v3"),
    "p14_normalisations": oracle("v5", "SELECT doc_id, " + ", ".join(f"{q} AS {n}" for n, q in _NORM.items()).replace("lower(x)", "lower(ref)") + " FROM v5"),
    "p15_character_census": f"SELECT doc_id, CAST(length(text) - length(translate(text, '{A}', '')) AS INTEGER) AS acentos, CAST(length(text) - length(translate(text, '.,;:!?', '')) AS INTEGER) AS puntuacion, CAST(length(text) AS INTEGER) AS n FROM documents",
    "p16_token_signals": f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), m AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END AS media,
 CASE WHEN len(w) > 0 THEN 100.0 * len(list_filter(w, lambda x: length(x) = 1)) / len(w) ELSE 0 END AS una, CASE WHEN len(w) > 0 THEN 100.0 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[a-zA-Z]'))) / len(w) ELSE 0 END AS no_alfa,
 CASE WHEN len(w) > 0 THEN 100.0 * len(list_filter(w, lambda x: NOT regexp_matches(lower(x), '[aeiou]'))) / len(w) ELSE 0 END AS sin_vocal FROM w)
SELECT doc_id, CAST(n AS INTEGER) AS tokens, round(media, 6)::DOUBLE AS media, round(una, 6)::DOUBLE AS una, round(no_alfa, 6)::DOUBLE AS no_alfa, round(sin_vocal, 6)::DOUBLE AS sin_vocal, n >= 8 AND (media < 3.0 OR una >= 50) AS sospecha FROM m""",
    "p17_collapse": oracle("v5", "SELECT doc_id, round(cer, 6)::DOUBLE AS cer, CASE WHEN length(sal) = 0 THEN 'SILENCIO' WHEN length(sal) <= 25 AND cer >= 90 THEN 'ATOMICA' WHEN length(sal) > 1.3 * length(ref) / 2 AND cer > 50 THEN 'ALUCINACION' ELSE 'normal' END AS clase FROM (SELECT *, CASE WHEN length(ref) > 0 THEN 100.0 * levenshtein(ref, sal) / length(ref) END AS cer FROM (SELECT doc_id, ref, substr(ref, CAST(doc_id % 7 AS INT) + 1, CAST(doc_id % 4 * 120 AS INT)) AS sal FROM (SELECT doc_id, " + _NORM["n10"].replace("lower(x)", "lower(ref)") + " AS ref FROM v5)))"),
    "p19_cost_line": oracle("v3", f"SELECT l_orderkey, l_linenumber, round({_MPX}, 6)::DOUBLE AS coste, round(CASE WHEN libre - 256.0 >= 1533.0 THEN -1.0 WHEN libre - 256.0 < 428.0 THEN 0.0 ELSE (libre - 256.0 - 428.0) / 235.0 END, 6)::DOUBLE AS mpx_max FROM (SELECT *, {_FREE} AS libre FROM v3) WHERE libre IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, round({_MPX}, 6)::DOUBLE, NULL FROM v3 WHERE l_linenumber >= 7"),
    "p20_admission": oracle("v3", f"SELECT l_orderkey, l_linenumber, CASE WHEN libre IS NULL OR {_MPX} + 256.0 <= libre THEN 'admitir' WHEN {_MPX} + 256.0 <= libre + l_linenumber * 150.0 THEN 'reciclar' ELSE 'rechazar' END AS decision FROM (SELECT *, {_FREE} AS libre FROM v3)"),
    "p21_budget": oracle("v8", "SELECT ajuste, doc, coalesce(medido, suma) AS total, coalesce(medido, suma) <= 950 AS cumple_techo, coalesce(medido, suma) <= 1000 AS cabe, medido IS NULL AS supuesta FROM (SELECT *, round(metrica_a * 100 + metrica_b * 100, 7) AS suma, CASE WHEN n % 2 = 0 THEN round(metrica_a * 190, 7) END AS medido FROM v8)"),
    "s7_last_pass": oracle("v3", "SELECT destino, count(*) FILTER (prof_ent <> 16) AS celdas, count(*) FILTER (prof_ent = 16) AS apartadas, round(sum(obtenido_bps) FILTER (prof_ent <> 16), 3) AS bps FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, destino ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM v3) WHERE r = 1 GROUP BY destino"),
    "s9_job_store": oracle("v12", "SELECT job, arg_max(estado, row(ts, event_id)) AS estado, count(*) AS eventos FROM v12 GROUP BY job"),
}
