"""Views on the tables that stand in for files, requests, probes, measurements and job records.

Each text runs unchanged in Spark SQL and in DuckDB, so that a query and its SQL start from the same rows.
"""

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# What was read in place of `text` (v5).
READINGS = {"lectura_a": "replace(text, 'e', 'c')", "lectura_b": "replace(replace(text, 'n', 'm'), '.', '')"}

VIEWS: dict[str, str] = {
    "v1": """SELECT concat('page_', page_id, '.html') AS name, html AS body FROM pages
UNION ALL SELECT concat('doc_', doc_id, '.', CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'MD' WHEN 2 THEN 'markdown' ELSE 'html' END), text FROM documents""",
    "v2": """SELECT o.o_custkey AS job, count(DISTINCT o.o_orderkey) AS filas_ent, count(DISTINCT l.l_orderkey) AS filas_sal,
 CASE WHEN o.o_custkey % 7 = 0 THEN 'k,s,p' ELSE 'k,s,p,d' END AS cab_sal, 'k,s,p,d' AS cab_ent,
 CASE WHEN o.o_custkey % 11 = 0 THEN 2 ELSE 1 END AS anchos_distintos,
 o.o_custkey % 13 = 0 AS bom, o.o_custkey % 17 = 0 AS ufffd, o.o_custkey % 19 = 0 AS sin_sonda_ent
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey""",
    "v3": """SELECT l_orderkey, l_partkey, l_linenumber,
 CASE l_returnflag WHEN 'A' THEN 'imagen' WHEN 'N' THEN 'av' ELSE 'pdf' END AS categoria,
 CASE l_partkey % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'opus' ELSE 'flac' END AS destino,
 100 + l_partkey % 900 AS ancho_ent, 100 + l_partkey % 900 + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS ancho_sal,
 CASE WHEN l_suppkey % 3 = 0 THEN 16 ELSE 8 END AS prof_ent, 8 AS prof_sal,
 l_extendedprice / 1000 AS dur_ent, l_extendedprice / 1000 + l_tax / 5 AS dur_sal,
 2 + l_linenumber % 2 AS pistas_ent, 2 AS pistas_sal, 44100 AS sr_ent,
 CASE WHEN l_linenumber = 7 THEN 48000 ELSE 44100 END AS sr_sal,
 1000000 AS pedido_bps, 1000000 * (0.3 + l_discount * 20) AS obtenido_bps, l_linenumber % 3 AS n_audio, l_shipdate
FROM lineitem""",
    "v4_formats": "SELECT n_nationkey AS ext, n_nationkey % 3 = 0 AS texto, n_nationkey % 2 = 0 AS perdida, n_regionkey AS familia FROM nation",
    "v4_edges": """SELECT origen, destino, motor, CASE (origen * 7 + destino) % 5 WHEN 0 THEN 'nominal' WHEN 1 THEN 'sin_sondear' ELSE 'real' END AS estado,
 1.0 + (origen * 3 + destino) % 10 AS coste, (origen + destino) % 6 = 0 AS rasteriza
FROM (SELECT origen, destino, motor, row_number() OVER (PARTITION BY origen ORDER BY n DESC, destino) AS r
 FROM (SELECT c.c_nationkey AS origen, s.s_nationkey AS destino, concat('m', (c.c_nationkey + s.s_nationkey) % 4) AS motor, count(*) AS n
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
  WHERE c.c_nationkey <> s.s_nationkey GROUP BY c.c_nationkey, s.s_nationkey) x) y WHERE r <= 3""",
    "v5": "SELECT doc_id, lang, source, text AS ref, " + ", ".join(f"{x} AS {c}" for c, x in READINGS.items()) + ", n_chars FROM documents",
    "v5_ajeno": """SELECT w.doc_id, n.text AS ajeno FROM (SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS sigue FROM documents) w
LEFT JOIN documents n ON n.doc_id = w.sigue""",
    "v6": "SELECT d.doc_id, d.text, l.quality, l.toxic, l.doc_id IS NOT NULL AS registrado FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "v8": """SELECT p.p_type AS ajuste, p.p_brand AS doc, avg(l.l_discount) * 100 AS metrica_a, avg(l.l_tax) * 100 AS metrica_b, count(*) AS n
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY p.p_type, p.p_brand""",
    "v8_sweep": """SELECT l_orderkey, l_linenumber, l_returnflag AS fuente, CASE WHEN l_linestatus = 'O' THEN 'legitima' ELSE 'patologica' END AS clase,
 CASE WHEN l_linestatus = 'O' THEN l_discount - 0.05 ELSE (l_discount - 0.05) * 8 END AS desvio, l_quantity % 3 AS n_audio
FROM lineitem""",
    "v9": "SELECT user_id, CAST(ts AS DATE) AS dia, user_id % 3 AS catalogo, user_id % 5 AS estrato, event_id, ts, event_type AS herramienta, value AS coste FROM events",
    "v11": """SELECT o_custkey AS job, 'antes' AS fase, concat('d', o_custkey % 2) AS dir, o_orderkey AS nombre, CAST(floor(o_totalprice) AS BIGINT) AS tam
FROM orders WHERE o_orderkey % 2 = 0
UNION ALL
SELECT o_custkey, 'despues', concat('d', o_custkey % 2), o_orderkey, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END
FROM orders WHERE o_orderkey % 3 <> 0""",
    "v12": "SELECT user_id AS job, event_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'working' END AS estado, value AS ms FROM events",
    # Tools with a JSON schema; every seventeenth schema is cut off.
    "v15": """SELECT p_partkey AS id, p_partkey % 4 AS catalogo, replace(lower(concat(p_brand, '_', p_type, ' ', CASE WHEN p_partkey % 3 = 0 THEN 'Tool-Kit' ELSE '' END)), '#', '_') AS nombre,
 concat('Makes a  ', lower(p_type), CASE WHEN p_size % 9 = 0 THEN ', same as below' WHEN p_size % 9 = 1 THEN ' (TODO)' ELSE '' END, '.', CASE WHEN p_partkey % 2 = 0 THEN concat('
', 'Args: size') ELSE '' END) AS descripcion,
 concat('{"properties": {"name": {"type": "string"', CASE WHEN p_partkey % 4 > 0 THEN ', "description": "a name"' ELSE '' END, '}', CASE WHEN p_partkey % 2 = 0 THEN ', "size": {"description": "how many", "type": "integer"}' ELSE '' END,
  CASE WHEN p_partkey % 6 < 3 THEN concat(', "options": {"type": "object"', CASE WHEN p_partkey % 5 = 0 THEN ', "properties": {"deep": {"type": "boolean"}}' ELSE '' END, '}') ELSE '' END,
  CASE WHEN p_partkey % 7 = 1 THEN concat(', "rows": {"type": "array", "description": "what to write", "items": {"type": "', CASE WHEN p_partkey % 4 = 1 THEN 'string' ELSE 'object' END, '"', CASE WHEN p_partkey % 4 = 0 THEN ', "properties": {"x": {}}' ELSE '' END, '}}') ELSE '' END,
  CASE WHEN p_partkey % 10 = 3 THEN ', "any": {}' ELSE '' END, '}, "required": [', CASE WHEN p_partkey % 3 > 0 THEN '"name", "options"' ELSE '' END, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE ']}' END) AS esquema FROM part""",
    # Tracks of files before and after: an order is a file, its lines are tracks.
    "v13": """SELECT l_orderkey AS job, 'entrada' AS lado, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 100000 + l_suppkey AS orden, CASE l_returnflag WHEN 'A' THEN 'video' WHEN 'N' THEN 'audio' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'audio' ELSE 'subtitulo' END END AS tipo,
 CASE l_partkey % 5 WHEN 0 THEN 'aac' WHEN 1 THEN 'flac' WHEN 2 THEN 'opus' WHEN 3 THEN 'tta' ELSE 'mp3' END AS codec, CAST(2 AS INT) AS canales, CAST(CASE WHEN l_suppkey % 3 = 0 THEN 48000 ELSE 44100 END AS INT) AS sample_rate,
 CAST(CASE WHEN l_returnflag = 'A' THEN 640 END AS INT) AS ancho, CAST(CASE WHEN l_returnflag = 'A' THEN 360 END AS INT) AS alto, CAST(l_extendedprice / 1000 AS DOUBLE) AS dur, CAST(CASE WHEN l_partkey % 3 = 0 THEN 16 END AS INT) AS bits, CAST(128000 AS DOUBLE) AS bitrate_bps FROM lineitem
UNION ALL SELECT l_orderkey, 'salida', CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 100000 + l_suppkey, CASE l_returnflag WHEN 'A' THEN 'video' WHEN 'N' THEN 'audio' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'audio' ELSE 'subtitulo' END END,
 CASE l_partkey % 5 WHEN 0 THEN 'aac' WHEN 1 THEN 'flac' WHEN 2 THEN 'libopus' WHEN 3 THEN 'tta' ELSE 'mp3' END, CAST(CASE WHEN l_suppkey % 11 = 0 THEN 1 WHEN l_suppkey % 13 = 0 THEN NULL ELSE 2 END AS INT), CAST(CASE WHEN l_suppkey % 17 = 0 THEN 4000 WHEN l_partkey % 5 = 2 THEN 48000 WHEN l_suppkey % 3 = 0 THEN 48000 ELSE 44100 END AS INT),
 CAST(CASE WHEN l_returnflag = 'A' AND l_suppkey % 19 > 0 THEN CASE WHEN l_suppkey % 7 = 0 THEN 320 ELSE 640 END END AS INT), CAST(CASE WHEN l_returnflag = 'A' THEN 360 END AS INT), CAST(l_extendedprice / 1000 + CASE WHEN l_suppkey % 4 = 0 THEN l_tax / 2 ELSE 0 END AS DOUBLE), CAST(CASE WHEN l_partkey % 3 = 0 THEN 24 END AS INT), CAST(128000 * (0.4 + l_discount * 12) AS DOUBLE)
 FROM lineitem WHERE l_suppkey % 10 > 0
UNION ALL SELECT l_orderkey, 'salida', 1000000000000, 'subtitulo', 'srt', CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS DOUBLE), CAST(NULL AS INT), CAST(NULL AS DOUBLE) FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 23 = 0""",
    # Files before and after, and what was asked.
    "v14": """SELECT o_orderkey AS job, CASE WHEN o_custkey % 16 = 0 THEN NULL WHEN o_orderkey % 5 < 2 THEN 'av' WHEN o_orderkey % 5 = 2 THEN 'pdf' ELSE 'imagen' END AS categoria_ent,
 CASE WHEN o_orderkey % 5 < 2 THEN 'av' WHEN o_custkey % 4 = 0 THEN 'pdf' ELSE 'imagen' END AS categoria_sal, CASE o_orderkey % 7 WHEN 0 THEN 'gif' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' WHEN 3 THEN 'png' WHEN 4 THEN 'mp4' WHEN 5 THEN 'opus' ELSE 'mkv' END AS destino,
 CASE WHEN o_orderkey % 5 > 2 THEN 800 + o_custkey % 700 END AS ancho_ent, CASE WHEN o_orderkey % 5 > 2 THEN 600 END AS alto_ent,
 CASE WHEN o_orderkey % 5 >= 2 AND o_custkey % 4 > 0 AND o_custkey % 25 > 0 THEN CASE WHEN o_custkey % 24 = 1 THEN 1 ELSE 800 + (o_custkey + CASE WHEN o_orderkey % 12 = 0 THEN 40 ELSE 0 END) % 700 END END AS ancho_sal, CASE WHEN o_orderkey % 5 >= 2 AND o_custkey % 4 > 0 THEN 600 END AS alto_sal,
 CASE WHEN o_orderkey % 5 > 2 THEN CASE WHEN o_custkey % 3 = 0 THEN 16 ELSE 8 END END AS bits_ent, CASE WHEN o_orderkey % 5 > 2 THEN CASE WHEN o_custkey % 9 = 0 THEN 16 WHEN o_custkey % 31 = 0 THEN 7 ELSE 8 END END AS bits_sal,
 o_orderkey % 2 = 0 AS alfa_ent, o_orderkey % 6 = 0 AS alfa_sal, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 * 64 END AS alfa_min_ent, CAST(NULL AS INT) AS alfa_min_sal,
 CAST(CASE WHEN o_orderkey % 5 < 2 THEN o_totalprice / 1000 END AS DOUBLE) AS dur_ent, CAST(CASE WHEN o_orderkey % 5 < 2 THEN CASE WHEN o_custkey % 27 = 0 THEN 0 ELSE o_totalprice / 1000 + o_custkey % 8 / 100 END END AS DOUBLE) AS dur_sal,
 CAST(NULL AS DOUBLE) AS ppp_ent, CAST(CASE WHEN o_orderkey % 5 >= 2 THEN 148 + o_custkey % 5 END AS DOUBLE) AS ppp_sal, CAST(CASE WHEN o_orderkey % 5 = 2 THEN 400 END AS DOUBLE) AS ancho_pt_ent,
 CAST(CASE WHEN o_custkey % 4 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 800 + o_custkey % 700 ELSE (800 + o_custkey % 700) * 72.0 / 150 + o_custkey % 3 END END AS DOUBLE) AS ancho_pt_sal,
 CASE WHEN o_orderkey % 5 = 2 THEN 1 + o_custkey % 3 END AS paginas_ent, CASE WHEN o_custkey % 4 = 0 THEN o_custkey % 3 END AS paginas_sal, false AS comprimido_ent, o_custkey % 2 = 0 AND o_orderkey % 2 = 0 AS comprimido_sal,
 CAST(NULL AS DOUBLE) AS bitrate_bps_ent, CAST(CASE WHEN o_orderkey % 5 < 2 THEN CASE WHEN o_custkey % 29 = 0 THEN 0 ELSE 300000 + o_custkey % 10 * 200000 END END AS DOUBLE) AS bitrate_bps_sal,
 o_custkey % 8 = 0 AS pide_flujos, o_custkey % 9 = 0 AS solo_audio, o_custkey % 11 = 0 AS solo_video, o_custkey % 13 = 0 AS recortar, CASE WHEN o_custkey % 6 = 0 THEN 800 + o_custkey % 700 END AS pide_ancho, CASE WHEN o_custkey % 12 = 0 THEN 600 + o_orderkey % 2 END AS pide_alto,
 CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 >= 2 THEN 150 END AS dpi, CASE WHEN o_custkey % 21 = 0 THEN 8 END AS pide_bits, CAST(CASE WHEN o_custkey % 14 = 0 THEN 25 END AS DOUBLE) AS fps, CASE WHEN o_custkey % 10 = 0 THEN 48000 END AS pide_sr, CASE WHEN o_custkey % 15 = 0 THEN 1 END AS pide_canales,
 CAST(CASE WHEN o_custkey % 2 = 0 THEN 1000000 END AS DOUBLE) AS pide_video_bps, CAST(CASE WHEN o_custkey % 2 = 1 THEN 128000 END AS DOUBLE) AS pide_bps FROM orders""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A view over the tables of sf_dir, or those given in their place. The tables are passed as arguments, so sessions keep no names."""
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = {t: given.get(t) or table(spark, sf_dir, t) for t in TABLES if f" {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **used)


def oracle(names: str, body: str) -> str:
    """DuckDB SQL: the named views, then the body (which may begin with further WITH members after a comma)."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names.split()) + "\n" + body
