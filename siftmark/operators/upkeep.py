"""Upkeep of a collection of files and notes: references, large binaries, open headings, error logs, counters, contracts."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bytes from which a binary is large, and where its NUL is looked for; headings that say that work goes on.
LARGE, WINDOW = 512 * 1024, 8192
OPEN_HEADING = r"(?i)^#{2,4} .*(en curso)"


def dead_references(texts: DataFrame, key: str, text: str, pattern: str, known: DataFrame, ref: str, foreign: Sequence[str] = ()) -> DataFrame:
    """(key, ref): references in texts (group 1 of the pattern) that known (ref) doesn't have, less the foreign ones, once a text."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), 1))).alias(ref))
    if foreign:
        found = found.where(~F.col(ref).isin(*foreign))
    return found.join(known.select(ref).distinct(), ref, "left_anti").select(key, ref)


def large_binaries(heads: DataFrame, allowed: Sequence[str] = (), limit: int = LARGE, window: int = WINDOW) -> DataFrame:
    """(path, size) of heads (path, size, head) over limit bytes, with a NUL in the first `window`, and below none of the allowed
    prefixes. heads must hold that many bytes: see sources.files.headers."""
    big = heads.where((F.col("size") > limit) & (F.instr(F.decode(F.substring("head", 1, window), "ISO-8859-1"), "\0") > 0))
    for prefix in allowed:
        big = big.where(~F.startswith("path", F.lit(prefix)))
    return big.select("path", "size")


def matching_lines(texts: DataFrame, key: str, text: str, pattern: str = OPEN_HEADING, width: int = 80) -> DataFrame:
    """(key, line from 1, content): the lines that fit a pattern, by default headings of work in progress, cut to width."""
    lines = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)).alias("_k", "_l"))
    return lines.where(F.col("_l").rlike(pattern)).select(key, (F.col("_k") + 1).alias("line"), F.substring("_l", 1, width).alias("content"))


def _first_of(text: Column, choices: Sequence[tuple[str, str]], otherwise: str) -> Column:
    out = F.when(F.lit(False), "")
    for needle, value in choices:
        out = out.when(F.contains(text, F.lit(needle)), value)
    return out.otherwise(otherwise)


def triage(logs: DataFrame, key: str, log: str, nodes: Sequence[tuple[str, str]], causes: Sequence[str], otherwise: str = "otro", width: int = 160) -> DataFrame:
    """(key, node, line, cause) of error logs: the node that the first needle found in the log names, and its first line (from 1) with
    one of the cause phrases, in any case; null if no line has one."""
    low = F.lower(F.coalesce(F.col(log), F.lit("")))
    lines = F.transform(F.split(F.coalesce(F.col(log), F.lit("")), "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), F.substring(F.trim(x), 1, width).alias("cause"), F.lower(x).alias("low")))
    hit = F.get(F.filter(lines, lambda x: _first_of(x["low"], [(c.lower(), "y") for c in causes], "n") == "y"), 0)
    return logs.select(key, _first_of(low, [(n.lower(), v) for n, v in nodes], otherwise).alias("node"), hit["line"].alias("line"), hit["cause"].alias("cause"))


def capability_contract(requests: DataFrame, measured: DataFrame, holds: DataFrame) -> DataFrame:
    """(origen, destino, contrato, perdidas): what conversions of requests (origen, destino) must keep, the properties measured (origen, props)
    that the target holds (destino, props); and those that it can't. A format that nothing is known of has none."""
    none = F.array().cast("array<string>")
    x = requests.join(measured.select("origen", F.col("props").alias("_m")), "origen", "left").join(holds.select("destino", F.col("props").alias("_h")), "destino", "left")
    has, can = F.coalesce("_m", none), F.coalesce("_h", none)
    return x.select("origen", "destino", F.array_sort(F.array_intersect(has, can)).alias("contrato"), F.array_sort(F.array_except(has, can)).alias("perdidas"))


def counters(runs: DataFrame, state: str, skipped: Column, listed: str, polls: int) -> DataFrame:
    """One row of what became of listings: seen, mature, served, skipped because their output exists, postponed, given up. runs: as
    arrivals.with_patience() gives them, with how often each was listed."""
    done = F.col(state).isin("servido", "desistido")
    return runs.agg(
        F.sum(listed).alias("vistos"), F.count_if(F.col(listed) >= polls).alias("maduros"), F.count_if(done & ~skipped).alias("atendidos"), F.count_if(done & skipped).alias("saltados"),
        F.count_if(F.col(state) == "pospuesto").alias("aplazados"), F.count_if(F.col(state) == "desistido").alias("rendidos"),
    )


def first_choices(runs: DataFrame, catalogue: str, tools: str, cost: str, seconds: str) -> DataFrame:
    """(catalogue, runs, calls, cost, seconds, tool, chosen, rank): means of each catalogue, and the tools that its runs took first, from
    the most chosen on; ties in the order of names."""
    first = F.coalesce(F.get(tools, 0), F.lit("-"))
    means = runs.groupBy(catalogue).agg(F.count("*").alias("runs"), F.round(F.avg(F.size(tools)), 5).alias("calls"), F.round(F.avg(cost), 5).alias("cost"), F.round(F.avg(seconds), 5).alias("seconds"))
    chosen = runs.groupBy(catalogue, first.alias("tool")).agg(F.count("*").alias("chosen"))
    rank = F.row_number().over(Window.partitionBy(catalogue).orderBy(F.desc("chosen"), "tool"))
    return means.join(chosen.withColumn("rank", rank), catalogue)
