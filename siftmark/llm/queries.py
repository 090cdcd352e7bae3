"""The registered queries of this subpackage, one for each operator over its whole table, and SQL where it can say the same."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, collocations, lines, merkle, mixing, quality, secrets, sharding, simhash, spelling, vectors, warc
from .common import new_shared_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _, _ = quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "log_weight")


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    found = warc.records(warc.read_archives(spark, path, with_payload=False), whole=True)
    page = lambda c: F.expr(f"try_cast(substring({c}, 11, length({c}) - 11) AS bigint)")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SHARD_NAMES = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARD_NAMES)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), max_repeats=MIX_REPEATS, block_tokens=MIX_BLOCK)


MIX_REPEATS, MIX_BLOCK = 1.25, 100_000


def _spans(spans, kinds=None):
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.against_edits(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(_spans(spans, ["assign", "access", "hex"]), 256).alias("base_sha256")
    return secrets.scan(_table(spark, sf_dir, "documents")).select("doc_id", of("assign"), of("access"), of("hex"), base, _spans(spans).alias("spans"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped")


def op9_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    done = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_importance_resampling, op2_warc_salvage, op3_simhash_pivots, op4_sharding, op5_mixing,
    op6_merkle, op7_secrets, op8_fuzzy_lines, op9_anisotropic_search, op10_bpe,
    op11_collocations, op12_spelling_variants, op13_vector_groups,
)}

ORACLE: dict[str, str] = {
    "op2_warc_salvage": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN p.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest""",
    # Shards take turns; the state is each shard's next preference and each slot's owner.
    "op4_sharding": f"""
WITH RECURSIVE n(slots, shards) AS (SELECT {sharding.SLOTS}, {sharding.SHARDS}),
 prefer AS (SELECT i AS shard, CAST('0x' || substr(m, 1, 15) AS BIGINT) % slots AS start, CAST('0x' || substr(m, 16, 15) AS BIGINT) % (slots - 1) + 1 AS step
  FROM (SELECT i, md5('shard-' || lpad(CAST(i AS VARCHAR), 3, '0')) AS m FROM range({sharding.SHARDS}) r(i)) x, n),
 lists AS (SELECT list(start ORDER BY shard) AS starts, list(step ORDER BY shard) AS steps FROM prefer),
 fill(turn, slot, taken) AS (
  SELECT 0, CAST(-1 AS BIGINT), list_transform(range(slots), lambda x: false) FROM n
  UNION ALL
  SELECT turn + 1, pick, list_transform(taken, lambda x, i: x OR i = pick + 1)
  FROM (SELECT turn, taken, (s + k * list_filter(range(slots), lambda j: NOT taken[(s + k * j) % slots + 1])[1]) % slots AS pick
   FROM (SELECT turn, taken, slots, starts[turn % shards + 1] AS s, steps[turn % shards + 1] AS k FROM fill, lists, n WHERE turn < slots) x) y)
SELECT d.doc_id, d.slot, CAST((f.turn - 1) % {sharding.SHARDS} AS INTEGER) AS shard
FROM (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, 15) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot FROM documents) d
JOIN fill f ON f.slot = d.slot""",
    "op5_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS key, source,
  CAST('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS row,
  CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS BIGINT) AS n_tokens FROM documents),
 s AS (SELECT key, count(*) AS n_docs, sum(n_tokens) AS n_tokens FROM d GROUP BY key HAVING sum(n_tokens) > 0),
 a AS (SELECT CAST(sum(n_tokens) AS DOUBLE) AS t, list(n_tokens / (SELECT sum(n_tokens) FROM s) ORDER BY n_tokens) AS p FROM s),
 b(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, CASE WHEN list_max(list_transform(p, lambda x: 1 / (x * t))) * t / len(p) <= {MIX_REPEATS} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM a
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN lo ELSE mid END, CASE WHEN good THEN mid ELSE hi END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
    list_max(list_transform(p, lambda x: pow(x, (lo + hi) / 2) / (x * t))) * t / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) <= {MIX_REPEATS} AS good
    FROM b, a WHERE step < {mixing.STEPS}) y),
 e AS (SELECT round(hi, 9) AS exponent FROM b WHERE step = {mixing.STEPS}),
 w AS (SELECT key, s.n_tokens, CAST(floor(round(pow(s.n_tokens / t, exponent) / list_sum(list_transform(p, lambda x: pow(x, exponent))) * t, 3)) AS BIGINT) AS quota FROM s, a, e),
 n AS (SELECT greatest(1, CAST(ceil(sum(quota) / {MIX_BLOCK}) AS BIGINT)) AS n_blocks FROM w),
 r AS (SELECT d.doc_id, d.source, d.key, u.epoch, d.n_tokens, w.quota, CAST('0x' || substr(md5(concat_ws('|', '0', CAST(u.epoch AS VARCHAR), CAST(d.row AS VARCHAR))), 1, 15) AS BIGINT) AS h
  FROM d JOIN w ON d.key = w.key CROSS JOIN range(1000) u(epoch) WHERE u.epoch <= w.quota // w.n_tokens),
 c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY key ORDER BY epoch, h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM r),
 k AS (SELECT *, CAST(least(floor(before / (quota / n_blocks)), n_blocks - 1) AS BIGINT) AS mix_block FROM c, n WHERE before + n_tokens <= quota)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, n_tokens, mix_block,
 CAST(row_number() OVER (PARTITION BY mix_block ORDER BY CAST('0x' || substr(md5(concat_ws('|', 'place', CAST(h AS VARCHAR))), 1, 15) AS BIGINT), key, epoch, doc_id, n_tokens) AS INTEGER) AS place FROM k""",
    "op11_collocations": f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
 g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, range(1, {collocations.LONGEST + 1}) r(k) WHERE len(w) >= k),
 f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= {collocations.LEAST}),
 c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
 x AS (SELECT c.*, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest FROM c, range(1, {collocations.LONGEST}) r(cut) WHERE cut < k),
 s AS (SELECT x.lang, x.phrase, x.k, x.a, x.w, x.cut, l.a AS l, r.a AS r, CAST(1000000::HUGEINT * x.a * x.a // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 o AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) y GROUP BY lang, phrase),
 e AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < {collocations.COVERED} * b.a)
SELECT e.lang, row_number() OVER (PARTITION BY e.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM e JOIN n ON n.lang = e.lang QUALIFY row_number() OVER (PARTITION BY e.lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
