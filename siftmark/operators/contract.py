"""The verification contract: declarative rules over pairs of input and output.

A rule is a name, a point of the contract, and a Column that gives a severity or null. All rules of a set are
evaluated in one pass over the pairs; a row's worst finding follows from the row, and only that is shuffled by pair. NULL in a probe means "not
measured": a rule must answer `informativo` or nothing then, never pass it silently, and coverage() says which
points could be checked at all.
"""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Severities and verdicts.
FAIL, WARN, INFO = "fallo", "aviso", "informativo"
OK, PARTIAL = "ok", "ok_parcial"
# Depths that targets can hold (others: any); targets without alpha; thresholds.
DEPTH_LIMIT = {"jpeg": 8, "jpg": 8, "webp": 8, "gif": 8, "bmp": 8, "avif": 12, "heif": 12, "heic": 12, "pdf": 8}
NO_ALPHA = ("jpeg", "jpg", "pdf")
VIDEO_RATE_DRIFT, AUDIO_RATE_FAIL, AUDIO_RATE_WARN, ASPECT_DRIFT = 0.60, 0.50, 0.15, 0.02
DEPTHS = (1, 2, 4, 8, 10, 12, 16, 32)


class Rule(NamedTuple):
    name: str
    point: int
    severity: Column
    expected: Column
    obtained: Column
    message: str


def said(rules: Sequence[Rule]) -> Column:
    """What the rules have to say of a pair, in their order: an array in the pair's own row."""
    return F.array_compact(F.array(*[
        F.when(r.severity.isNotNull(), F.struct(F.lit(i).alias("seq"), F.lit(r.point).alias("point"), F.lit(r.name).alias("rule"), r.severity.alias("severity"), r.expected.cast("string").alias("expected"), r.obtained.cast("string").alias("obtained"), F.lit(r.message).alias("message")))
        for i, r in enumerate(rules)
    ]))


def findings(pairs: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """(keys, seq, point, rule, severity, expected, obtained, message): a row for each rule that has something to say. Severities
    are columns of their own first, so that none is worked out twice."""
    parts = {"s": [r.severity for r in rules], "e": [r.expected.cast("string") for r in rules], "o": [r.obtained.cast("string") for r in rules]}
    worked = pairs.select(*keys, *[x.alias(f"_{k}{i}") for k, columns in parts.items() for i, x in enumerate(columns)])
    named = [Rule(r.name, r.point, F.col(f"_s{i}"), F.col(f"_e{i}"), F.col(f"_o{i}"), r.message) for i, r in enumerate(rules)]
    return worked.select(*keys, F.explode(said(named)).alias("f")).select(*keys, "f.*")


def differ(name: str, point: int, a: str, b: str, message: str, severity: str = FAIL) -> Rule:
    """A rule that finds two measured columns different; unmeasured ones say nothing."""
    return Rule(name, point, F.when(F.col(a) != F.col(b), severity), F.col(a), F.col(b), message)


def track_count(expected: str, obtained: str) -> Rule:
    e, o = F.col(expected), F.col(obtained)
    return Rule("V3", 2, F.when(e.isNull(), INFO).when(o < e, FAIL).when(o > e, WARN), e, o, "tracks expected and obtained")


def depth(before: str, after: str, target: str) -> Rule:
    """Depth fell: inevitable if the target cannot hold it, a failure if it can."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in DEPTH_LIMIT.items() for x in kv]), F.col(target))
    return Rule("I5", 4, F.when(F.col(after) < F.col(before), F.when(limit < F.col(before), INFO).otherwise(FAIL)), F.col(before), F.col(after), "depth fell")


def alpha(lowest: str, has_after: str, target: str) -> Rule:
    """A non-trivial alpha channel (lowest value under 255) got lost; an unknown lowest value is not a pass."""
    low, kept = F.col(lowest), F.col(has_after)
    return Rule("I2", 4, F.when(kept, F.lit(None)).when(low.isNull(), INFO).when(low < 255, F.when(F.col(target).isin(*NO_ALPHA), INFO).otherwise(FAIL)), low, kept, "alpha lost")


def video_rate(asked: str, obtained: str, n_audio: str) -> Rule:
    """Asymmetric: far below is always a failure; far above is one only if no audio explains it."""
    drift = (F.col(obtained) - F.col(asked)) / F.col(asked)
    return Rule("V10", 4, F.when(drift < -VIDEO_RATE_DRIFT, FAIL).when(drift > VIDEO_RATE_DRIFT, F.when(F.col(n_audio) == 0, FAIL).otherwise(INFO)), F.col(asked), F.col(obtained), "video bit rate")


def audio_rate(asked: str, obtained: str) -> Rule:
    drift = F.abs(F.col(obtained) - F.col(asked)) / F.col(asked)
    return Rule("A-rate", 4, F.when(drift > AUDIO_RATE_FAIL, FAIL).when(drift > AUDIO_RATE_WARN, WARN), F.col(asked), F.col(obtained), "audio bit rate")


def duration(before: str, after: str, tolerance: Column) -> Rule:
    return Rule("A1/V1", 4, F.when(F.abs(F.col(after) - F.col(before)) > tolerance, FAIL), F.round(before, 4), F.round(after, 4), "duration drift")


def sample_rate(before: str, after: str, target: str) -> Rule:
    """Changed sample rate; Opus only runs at 48 kHz and is excused."""
    return Rule("A3", 4, F.when((F.col(before) != F.col(after)) & ~((F.col(target) == "opus") & (F.col(after) == 48000)), FAIL), F.col(before), F.col(after), "sample rate changed")


def aspect(w0: Column, h0: Column, w1: Column, h1: Column) -> Rule:
    return Rule("aspect", 4, F.when(F.abs(w0 / h0 - w1 / h1) > ASPECT_DRIFT, WARN), F.round(w0 / h0, 4), F.round(w1 / h1, 4), "aspect ratio moved")


def data_rules(facts: str) -> list[Rule]:
    """Point 3 of data files, over text.data_facts(): encoding, replacement characters, syntax, constant field counts; and an
    unasked byte order mark (point 4)."""
    f = lambda x: F.col(f"{facts}.{x}")
    return [
        Rule("D5-utf8", 3, F.when(~f("utf8_valido"), FAIL), F.lit(True), f("utf8_valido"), "not UTF-8"),
        Rule("D5", 3, F.when(f("reemplazo"), FAIL), F.lit(False), f("reemplazo"), "replacement characters"),
        Rule("D8", 3, F.when(~f("json_valido"), FAIL), F.lit(True), f("json_valido"), "invalid JSON"),
        Rule("D2", 3, F.when(F.size(f("anchos")) > 1, FAIL), F.lit(1), F.size(f("anchos")), "field count varies"),
        Rule("D4", 4, F.when(f("bom"), WARN), F.lit(False), f("bom"), "byte order mark"),
    ]


def severity_rank(severity: Column) -> Column:
    return F.when(severity == FAIL, 2).when(severity == WARN, 1).otherwise(0)


def worst(rules: Sequence[Rule]) -> Column:
    """The rank of a row's worst finding, from the row alone."""
    ranks = [severity_rank(r.severity) for r in rules]
    return F.greatest(*ranks) if len(ranks) > 1 else ranks[0] if ranks else F.lit(0)


def _verdict(rank: Column, covered: Column) -> Column:
    return F.when(rank == 2, FAIL).when(rank == 1, WARN).when(covered, OK).otherwise(PARTIAL)


def verdicts(pairs: DataFrame, rules: Sequence[Rule], keys: Sequence[str], covered: Column) -> DataFrame:
    """(keys, verdict): the worst severity of each pair; without failures and warnings ok, or ok_parcial if not every
    point was covered. Only (keys, rank, covered) is shuffled, once: rows that repeat a pair's keys share the worst."""
    rows = pairs.select(*keys, worst(rules).alias("rank"), covered.alias("covered"))
    return rows.select(*keys, _verdict(F.max("rank").over(Window.partitionBy(*keys)), F.col("covered")).alias("verdict"))


def coverage(points: dict[str, Column]) -> Column:
    """Which points could be checked at all, as a map."""
    return F.create_map(*[x for k, v in points.items() for x in (F.lit(k), F.coalesce(v, F.lit(False)))])


def coverage_ratio(covered: Column) -> Column:
    """'n/m' of the numbered points."""
    return F.concat_ws("/", F.size(F.map_filter(covered, lambda _, v: v)).cast("string"), F.size(covered).cast("string"))


def chain(hops: DataFrame, job: str, hop: str, verdict: str) -> DataFrame:
    """(job, verdict) of a chain of conversions: fallo if any hop failed, else the first warning or partial, else ok."""
    return hops.groupBy(job).agg(F.when(F.bool_or(F.col(verdict) == FAIL), FAIL).otherwise(F.coalesce(F.min_by(F.when(F.col(verdict) != OK, F.col(verdict)), F.when(F.col(verdict) != OK, F.col(hop))), F.lit(OK))).alias("verdict"))


def short(pairs: DataFrame, rules: Sequence[Rule], keys: Sequence[str], n: int = 3, width: int = 110) -> DataFrame:
    """The first n findings of each pair that aren't informative, messages cut to width. Each row gives its first n alone."""
    each = F.array(*[F.struct(F.lit(i).alias("seq"), r.severity.alias("severity")) for i, r in enumerate(rules)])
    first = F.slice(F.filter(each, lambda f: f["severity"] != INFO), 1, n)
    found = pairs.select(*keys, F.explode(first).alias("f")).select(*keys, "f.seq", "f.severity")  # names and texts follow from seq, and aren't shuffled
    out = found.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "severity"))).where(F.col("r") <= n)
    of = lambda texts: F.get(F.array(*map(F.lit, texts)), F.col("seq"))
    return out.select(*keys, "r", of([r.name for r in rules]).alias("rule"), "severity", of([r.message[:width] for r in rules]).alias("message"))


def summary(pairs: DataFrame, rules: Sequence[Rule], keys: Sequence[str], covered: Column) -> DataFrame:
    """One line for each pair: its verdict, and its first failure or else its first finding."""
    first = F.array_min(F.transform(said(rules), lambda f: F.struct(F.when(f["severity"] == FAIL, 0).otherwise(1).alias("mild"), f["seq"].alias("seq"), F.concat_ws(": ", f["rule"], f["message"]).alias("text"))))
    rows = pairs.select(*keys, worst(rules).alias("rank"), first.alias("first"), covered.alias("covered"))
    w = Window.partitionBy(*keys)
    rows = rows.select(*keys, F.max("rank").over(w).alias("rank"), F.min("first").over(w).alias("first"), "covered")
    return rows.select(*keys, F.concat_ws(" · ", _verdict(F.col("rank"), F.col("covered")), F.col("first.text")).alias("line"))


def census(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer comparison of two directory listings (keys, tam): nuevo, cambiado, perdido or igual."""
    both = before.withColumnRenamed("tam", "antes").join(after.withColumnRenamed("tam", "despues"), list(keys), "full_outer")
    state = F.when(F.col("antes").isNull(), "nuevo").when(F.col("despues").isNull(), "perdido").when(F.col("antes") != F.col("despues"), "cambiado").otherwise("igual")
    return both.withColumn("estado", state)


# Targets that come with further files; what such files end in.
SEVERAL_FILES = ("mpd", "m3u8", "html", "shtml", "ismv", "vtt")
SATELLITES = ("m4s", "ts", "png", "jpg", "jpeg", "shtml", "map", "vtt", "m3u8", "mpd", "webvtt")


def is_pattern(declared: Column) -> Column:
    return F.contains(declared, F.lit("%"))


def literal_prefix(declared: Column) -> Column:
    """What every name of a declared output begins with: all of it, but for a printf pattern what stands before the number."""
    return F.substring_index(declared, "%", 1)


def output_pattern(declared: Column) -> Column:
    """A declared output as an anchored regular expression; printf numbers (%d, %03d, %i, %u) are groups of digits."""
    plain = F.regexp_replace(declared, r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(plain, "%0?[0-9]*[diu]", "([0-9]+)"), F.lit("$"))


def is_declared(name: Column, declared: Column) -> Column:
    """Whether a file is the declared output, or one that its pattern stands for."""
    return F.when(is_pattern(declared), F.rlike(name, output_pattern(declared))).otherwise(name == declared)


def is_satellite(name: Column, declared: Column) -> Column:
    """Whether a file may come with the declared one: by its extension, or because its name holds the other's stem."""
    stem = F.regexp_replace(declared, r"\.[^.]*$", "")
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*SATELLITES) | (F.contains(name, stem) & (stem != ""))


def comes_in_several(target: Column, declared: Column, asked: Column | None = None) -> Column:
    """Whether further files beside the declared one are no surprise."""
    return target.isin(*SEVERAL_FILES) | is_pattern(declared) | (F.lit(False) if asked is None else F.coalesce(asked, F.lit(False)))


def numbered_outputs(listing: DataFrame, declared: DataFrame, keys: Sequence[str], name: str, pattern: str) -> DataFrame:
    """(keys, pattern, ficheros, primero, ultimo, huecos): the files of listing that each declared pattern stands for, from which
    number to which, and how many runs of numbers are missing between. declared: (keys, pattern); a pattern meets only
    names that begin as it does, and one that nothing matches has 0 files."""
    p = declared.where(is_pattern(F.col(pattern))).select(*keys, pattern)
    begin = literal_prefix(F.col(pattern))
    lengths = [r[0] for r in p.select(F.length(begin)).distinct().limit(1000).collect()]  # lengths of prefixes, not of names
    starts = F.explode(F.array_distinct(F.array(*[F.substring(name, 1, n) for n in lengths]))) if lengths else F.lit("")
    near = listing.select(*keys, name, starts.alias("_begin")).join(p.withColumn("_begin", begin), [*keys, "_begin"])
    met = near.where(F.rlike(F.col(name), output_pattern(F.col(pattern)))).select(*keys, pattern, F.call_function("regexp_extract", F.col(name), output_pattern(F.col(pattern)), F.lit(1)).cast("long").alias("_n"))
    jump = F.col("_n") - F.lag("_n").over(Window.partitionBy(*keys, pattern).orderBy("_n"))
    g = met.withColumn("_gap", (jump > 1).cast("int")).groupBy(*keys, pattern).agg(F.count("*").alias("ficheros"), F.min("_n").alias("primero"), F.max("_n").alias("ultimo"), F.coalesce(F.sum("_gap"), F.lit(0)).alias("huecos"))
    return p.distinct().join(g, [*keys, pattern], "left").withColumn("ficheros", F.coalesce("ficheros", F.lit(0)))


def writes(listing: DataFrame, job: str, target: Column, declared: Column, satellite: Column, several: Column | None = None) -> DataFrame:
    """Rules on what a job wrote: files outside the target folder (N5, N6), beside the output (N7), changed (N8), and the
    share of the declared output (N9). target, declared, satellite, several: predicates on the rows of census(); files beside the
    output are no warning if it comes in several files and they are all satellites."""
    size, new = F.coalesce("despues", F.lit(0)), F.col("estado") == "nuevo"
    several = F.lit(True) if several is None else several
    outside, beside = new & ~target, new & target & ~declared
    g = listing.groupBy(job).agg(
        F.sum(F.when(new & target & declared, size).otherwise(0)).alias("declared_bytes"), F.sum(F.when(outside, size).otherwise(0)).alias("outside_bytes"), F.count_if(outside).alias("outside"), F.count_if(beside).alias("beside"),
        F.count_if(beside & satellite & several).alias("satellites"), F.count_if(F.col("estado") == "cambiado").alias("changed"), F.sum(F.when(new, size).otherwise(0)).alias("written"),
    )
    return g.select(
        job, F.when(F.col("outside") > 0, F.when(F.col("outside_bytes") > F.greatest("declared_bytes", F.lit(1)), FAIL).otherwise(WARN)).alias("n5"),
        F.when(F.col("beside") > 0, F.when(F.col("beside") == F.col("satellites"), INFO).otherwise(WARN)).alias("n7"),
        F.when(F.col("changed") > 0, WARN).alias("n8"), F.when(F.col("written") > 0, F.round(F.col("declared_bytes") / F.col("written"), 6)).alias("n9"),
    )


def batch(jobs: DataFrame, job: str, state: str, output: str, order: Column) -> DataFrame:
    """A batch's outcome: converted, failed, its first five outputs, and COMPLETADO only if none failed."""
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.struct(order.alias("o"), F.col(output).alias("x"))))), lambda s: s["x"]), 1, 5)
    w = Window.partitionBy(job, state).orderBy(order)
    rows = jobs.withColumn("n", F.when(F.col(state) == "completed", F.row_number().over(w)))
    ok, bad = F.count_if(F.col(state) == "completed"), F.count_if(F.col(state) == "failed")
    return rows.groupBy(job).agg(ok.alias("converted"), bad.alias("failed"), first.alias("outputs"), F.when(F.count_if(F.col(state) == "cancelled") > 0, "CANCELADO").when(bad == 0, "COMPLETADO").otherwise("FALLIDO").alias("state"))
