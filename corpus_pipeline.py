"""The corpus pipeline: quality, repeated lines, near-duplicates, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and reads
again for the next stage. All but the last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.llm import bpe, lines, mixing, quality, simhash
from siftmark.llm.common import new_shared_path


BATCH = "4m"  # of rows that a task hands to Python at a time


def in_small_batches(spark: SparkSession) -> None:
    """For the session, as plans are made when a result is written: rows go to Python in batches of BATCH. JVM and workers hold a
    batch several times over, in each task; whole texts in batches of 10,000 rows took most of what is beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def target_like(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What importance resampling keeps: documents like those labelled good and not toxic."""
    in_small_batches(spark)
    return quality.keep_target_like(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of every group of similar lines; n_chars follows the text. A text that loses all its lines
    has nothing left to keep, and its row goes; empty texts that were so before stay."""
    in_small_batches(spark)
    out = lines.dedup_lines(docs)
    return out.where("n_dropped = 0 or length(trim(text)) > 0").select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group: linked are those whose SimHash fingerprints differ in three bits or fewer, as operator 3 finds them
    with blocks and pivots, and those whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    in_small_batches(spark)
    return simhash.drop_similar(docs, words=5, least=0.8, radius=3)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, of sources by temperature, none repeated more than one and a quarter times."""
    return mixing.mixed_documents(docs, max_repeats=1.25)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids as little-endian unsigned 32-bit integers."""
    in_small_batches(spark)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", F.col("ids"))


STAGES = [
    ("quality classifier", target_like),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_duplicates),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE", encoded),
]

#: No stage but the mixture could be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_shared_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
