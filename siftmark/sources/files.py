"""Sources and sinks: folders of files, probe documents, run logs, pivot tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats as fm
from . import folders

HEAD, LONG_HEAD = 512, 2056


def inventory(spark: SparkSession, path: str, recursive: bool = True, glob: str = "*") -> DataFrame:
    """(path, name, ext, size, mtime) of the files of a folder, those without a byte too. No file is opened. glob: a pattern for
    names, as in shells."""
    if folders.arrow_reads(path):
        found = folders.folder(spark, path, recursive=recursive, glob=glob)
    else:  # a file system that Arrow doesn't have: Spark lists it, and passes over files without a byte
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(path)
        found = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return found.select("path", "name", fm.normal_extension(fm.extension(F.col("name"))).alias("ext"), "size", "mtime")


def candidates(files: DataFrame, reach: DataFrame, target: str) -> DataFrame:
    """Files of an inventory whose extension can reach the target (reach: origen, destino) and isn't the target itself."""
    able = reach.where(F.col("destino") == target).select(F.col("origen").alias("ext")).distinct()
    return files.where(F.col("ext") != target).join(able, "ext", "left_semi")


def census(spark: SparkSession, path: str) -> DataFrame:
    """(dir, name, size) of every regular file below a folder."""
    files = inventory(spark, path)
    return files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), "name", "size")


def headers(spark: SparkSession, path: str, n: int = LONG_HEAD, tail: int = 0) -> DataFrame:
    """(path, size, head, tail, reason): the first n bytes of every file, and the last `tail`; only those are read. Where a file
    can't be opened both are null, and reason says why. On file systems that Arrow doesn't have Spark reads whole files."""
    if folders.arrow_reads(path):
        return folders.folder(spark, path, head=n, tail=tail).select("path", "size", "head", "tail", "reason")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    end = F.substring("content", -tail, tail) if tail else F.lit(b"")
    return files.select("path", F.col("length").alias("size"), F.substring("content", 1, n).alias("head"), end.alias("tail"), F.lit(None).cast("string").alias("reason"))


def decoded(content: Column) -> Column:
    """A file's text: UTF-8 without its byte order mark, else Latin-1, which never fails."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(utf8, F.regexp_replace(content.cast("string"), "^﻿", "")).otherwise(F.decode(content, "ISO-8859-1"))


def texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", decoded(F.col("content")).alias("text"), F.col("length").alias("size"))


def probes(spark: SparkSession, path: str) -> DataFrame:
    """(motor, build, huella map, aristas array) of probe documents, one JSON file an engine; unreadable ones are left out."""
    schema = "motor string, build string, huella map<string,string>, aristas array<struct<origen:string,destino:string,estado:string,ms:double>>, _corrupt_record string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
    return rows.where("_corrupt_record IS NULL AND motor IS NOT NULL").drop("_corrupt_record")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Runs that ended well, of a log in JSON lines."""
    schema = "catalogo string, tarea string, estrato int, herramientas array<string>, llamadas array<string>, coste_usd double, dur_s double, rc int"
    return spark.read.schema(schema).json(path).where("rc = 0")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pivot(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """A table of means, rows by columns; the columns are named, so Spark needn't look for them."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.round(F.avg(value), 6)).orderBy(row)
