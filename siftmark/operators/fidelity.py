"""How far an output is from its input: texts, and long tables of decoded values (pair, channel, pos, a, b)."""

import re
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import edits, media, text

SILENT_IN, SILENT_OUT = -60.0, -80.0


def _least_window(phrase: str, output: str) -> int:
    """The least edit distance of the phrase to a window of its length in output (to all of it, if that is shorter). A window lacks at
    least the characters that the phrase has more often: only windows where that bound is under the best found are compared, bit-parallel
    and all at once."""
    if phrase in output:
        return 0
    n = len(phrase)
    if len(output) <= n or n > 64:
        return min((edits.edit_distance(phrase, output[i : i + n]) for i in range(max(1, len(output) - n + 1))), default=n)
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (phrase, output))
    letters, often = np.unique(x, return_counts=True)
    lack = np.full(len(y) - n + 1, n, np.int16)
    masks = np.zeros(len(y), np.uint64)
    for c, k in zip(letters, often.tolist()):
        here = y == c
        upto = np.append(0, np.cumsum(here, dtype=np.int32))
        lack -= np.minimum(upto[n:] - upto[:-n], k).astype(np.int16)
        masks[here] = np.uint64(sum(1 << int(i) for i in np.flatnonzero(x == c)))
    best, full, last, one = n, np.uint64((1 << n) - 1), np.uint64(n - 1), np.uint64(1)
    for low in range(int(lack.min()), n):
        at = np.flatnonzero(lack == low)
        if low >= best or not len(at):
            if low >= best:
                break
            continue
        for i in range(0, len(at), 4096):
            some = at[i : i + 4096]
            up, down = np.full(len(some), full), np.zeros(len(some), np.uint64)
            score = np.full(len(some), n, np.int64)
            for j in range(n):
                same = masks[some + j]
                still = (((same & up) + up) ^ up) | same | down
                rises, falls = down | ~(still | up), still & up
                score += (rises >> last & one).astype(np.int64) - (falls >> last & one).astype(np.int64)
                rises, falls = rises << one | one, falls << one
                up, down = falls | ~(still | rises), rises & still
            best = min(best, int(score.min()))
            if low >= best:
                break
    return best


def phrase_recall(pairs: DataFrame, doc: str, phrases: str, output: str) -> DataFrame:
    """(doc, phrase, distance, similarity) of each of a row's distinct phrases (an array, each row's own): 0 where the output holds the phrase,
    else the least edit distance over all its windows of the phrase's length. Both stand in one row, so no window becomes a row; equal rows
    count once. Null phrases and outputs have no distance."""

    @F.pandas_udf("array<int>")
    def least(phrases: pd.Series, output: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else [None if x is None or y is None else _least_window(x, y) for x in p] for p, y in zip(phrases, output)])

    x = pairs.select(doc, F.array_distinct(phrases).alias("_p"), F.col(output).alias("_o"))
    x = x.select(doc, F.explode(F.arrays_zip(F.col("_p").alias("phrase"), least("_p", "_o").alias("distance"))).alias("_x"), F.sha2("_o", 256).alias("_of")).distinct()
    x, n = x.select(doc, "_x.phrase", "_x.distance"), F.length("phrase")
    return x.withColumn("similarity", F.when(n > 0, F.round(100.0 * F.greatest(F.lit(0), n - F.col("distance")) / n, 6)).otherwise(100.0))


def tasks(spark: SparkSession) -> int:
    """Into how many tasks work is dealt out that is more than reading its rows: several a core, as rows differ widely."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def error_rates(texts: DataFrame, key: str, ref: str, outputs: Sequence[str]) -> DataFrame:
    """(key, a rate for each of outputs): character error rates in percent of the reference's length, after normalisation:
    edit distances of whole texts, exact, in the row that holds both; an Arrow batch is normalised and compared at once. Null for a null
    output or an empty reference. The rows are dealt out anew: the joins before leave too few tasks for so much work on each byte. Where
    they are by tasks() and the key already, they stay."""

    @F.arrow_udf("struct<n: int, d: array<int>>")
    def compared(texts: pa.Array) -> pa.Array:
        refs, *outs = [text.normal_bytes(x) for x in texts.flatten()]
        pairs = [(i, k) for k, out in enumerate(outs) for i, (r, o) in enumerate(zip(refs, out)) if r and o is not None]
        found: list[list[int | None]] = [[None] * len(outs) for _ in refs]
        for (i, k), d in zip(pairs, edits.distances((refs[i], outs[k][i]) for i, k in pairs)):
            found[i][k] = d
        n = pa.array([None if r is None else len(r) for r in refs], pa.int32())
        return pa.StructArray.from_arrays([n, pa.array(found, pa.list_(pa.int32()))], ["n", "d"])

    t = texts.select(key, ref, *outputs).repartition(tasks(texts.sparkSession), key)
    t = t.select(key, compared(F.struct(ref, *outputs)).alias("_x"))
    return t.select(key, *[F.when(F.col("_x.n") > 0, F.round(100.0 * F.col("_x.d")[i] / F.col("_x.n"), 6)).alias(c) for i, c in enumerate(outputs)])


def _grams(texts: Sequence[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of k characters of all texts as numbers, equal ones of equal runs; and the text of each.

    Runs are written in the base of the characters that there are, which is exact as long as that fits 64 bits; if not,
    they are numbered in their order."""
    points = [np.frombuffer((x or "").encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    of = np.repeat(np.arange(len(points)), [len(p) for p in points])
    every = np.concatenate([*points, np.zeros(0, np.uint32)])
    there = np.zeros(int(every.max(initial=0)) + 1, bool)
    there[every] = True
    letters, code = np.flatnonzero(there), (np.cumsum(there) - 1)[every]
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for j in range(k):
        if len(letters) ** (j + 1) >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
        out = out * len(letters) + code[j : n + j]
    whole = of[:n] == of[k - 1 :]
    return out[whole], of[:n][whole]


def _shared(a: Sequence[str | None], b: Sequence[str | None], k: int) -> tuple[np.ndarray, ...]:
    """For each pair of texts: (runs of k characters that both have, as often as both have them, runs of a, runs of b)."""
    n = len(a)
    gram, of = _grams([*a, *b], k)
    if not len(gram):
        return (np.zeros(n, np.int64),) * 3
    top = int(gram.max()) + 1
    if 2 * n * top >= 1 << 63:
        gram = np.unique(gram, return_inverse=True)[1]
        top = int(gram.max()) + 1
    key = np.sort(((of % n) * top + gram) * 2 + (of >= n))  # by pair of texts and run, those of b behind those of a
    run = key >> 1
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    in_b = np.add.reduceat(key & 1, starts)
    in_a, row = np.diff(np.append(starts, len(key))) - in_b, run[starts] // top
    added = lambda x: np.bincount(row, x, n).astype(np.int64)
    return added(np.minimum(in_a, in_b)), added(in_a), added(in_b)


def overlap(k: int, words: bool) -> Callable[[Column, Column], Column]:
    """A function of two text columns: struct(common, in_a, in_b) of their multisets of k-grams, of characters or of words.

    Both texts stand in one row, so nothing is exploded or shuffled; an Arrow batch is counted at once, by sorting.
    """

    @F.pandas_udf("common long, in_a long, in_b long")
    def of(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        if not words:
            parts = [_shared(a[i : i + 256].tolist(), b[i : i + 256].tolist(), k) for i in range(0, len(a), 256)]
            return pd.DataFrame({c: np.concatenate([p[j] for p in parts]) if parts else [] for j, c in enumerate(("common", "in_a", "in_b"))})

        def multiset(x: str | None) -> Counter:
            w = re.findall("[^ \t\r\n]+", x or "")
            return Counter(w) if k == 1 else Counter(zip(*[w[i:] for i in range(k)]))

        def counts(x: str | None, y: str | None) -> tuple[int, int, int]:
            p, q = multiset(x), multiset(y)
            return (p & q).total(), p.total(), q.total()

        return pd.DataFrame([counts(x, y) for x, y in zip(a, b)], columns=["common", "in_a", "in_b"])  # a row's words go before the next row's come

    return of.asNondeterministic()  # or a filter on what it gives would be pushed below, and it and the texts' forms computed twice


def containment_class(share: Column) -> Column:
    return F.when(share < 0.80, "destruido").when(share < 0.98, "alterado").otherwise("integro")


def agreement_class(dice: Column) -> Column:
    """Two independent readings that agree recognised the text; ones that don't made it up; between is undecided."""
    return F.when(dice >= 0.80, "reconocido").when(dice <= 0.70, "inventado").otherwise("indeciso")


def text_kept(a: Column, b: Column, asked: Column) -> Column:
    """P5, P6 or P2, whichever a text layer breaks; null if it kept everything."""
    bare = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "\\s", "")
    return F.when(asked & (F.length(bare(b)) == 0), "P5").when(F.length(bare(b)) < 10, "P6").when(F.sha2(bare(a), 256) != F.sha2(bare(b), 256), "P2")


def errors(values: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b", peak: float = 1.0) -> DataFrame:
    """(keys, rmse, psnr, n): one pass with partial sums; psnr is infinite for equal series."""
    mse = F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    return values.groupBy(*keys).agg(mse.alias("mse"), F.count("*").alias("n")).select(*keys, F.sqrt("mse").alias("rmse"), media.psnr(F.col("mse"), peak).alias("psnr"), "n")


def psnr_rule(psnr: Column, lossy_alpha: Column, palette: Column, deep: Column) -> Column:
    """aviso under the threshold that suits the pair: 40 dB, 30 from deep sources, 20 for palette art, none with lossy alpha."""
    least = F.when(lossy_alpha, 0.0).when(palette, 20.0).when(deep, 30.0).otherwise(40.0)
    return F.when(psnr < 10, "fallo").when(psnr < least, "aviso")


def silent_channels(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, channel, in_db, out_db, severity): a channel that went silent is a failure."""
    g = values.groupBy(*keys, "channel").agg(media.dbfs(F.avg(F.col("a") * F.col("a"))).alias("in_db"), media.dbfs(F.avg(F.col("b") * F.col("b"))).alias("out_db"))
    return g.withColumn("severity", F.when((F.col("in_db") > SILENT_IN) & (F.col("out_db") <= SILENT_OUT), "fallo"))


def stream_identity(a: DataFrame, b: DataFrame, key: str, copied: Column) -> DataFrame:
    """(key, result) of two sample streams (key, pos, v): igual, recorte where a copy only lost or gained samples at the
    head or the tail (informativo), else distinto. Samples are matched at pos, and at pos plus the lengths' difference."""
    size = a.groupBy(key).agg(F.count("*").alias("na")).join(b.groupBy(key).agg(F.count("*").alias("nb")), key)

    def matches(shift: Column) -> DataFrame:
        moved = a.join(size, key).select(key, (F.col("pos") + shift).alias("pos"), F.col("v").alias("va"))
        return moved.join(b, [key, "pos"]).where("va = v").groupBy(key).agg(F.count("*").alias("same"))

    head = matches(F.col("nb") - F.col("na")).withColumnRenamed("same", "tail_same")
    out = size.join(matches(F.lit(0)), key, "left").join(head, key, "left").na.fill(0)
    shorter = F.least("na", "nb")
    return out.select(key, F.when((F.col("na") == F.col("nb")) & (F.col("same") == F.col("na")), "igual").when(copied & ((F.col("same") == shorter) | (F.col("tail_same") == shorter)), "recorte").otherwise("distinto").alias("result"))


def correlation(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, r): Pearson's r, 0 where a side is constant."""
    return values.groupBy(*keys).agg(F.when((F.min("a") == F.max("a")) | (F.min("b") == F.max("b")), 0.0).otherwise(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))).alias("r"))


def best_lag(a: DataFrame, b: DataFrame, key: str, most: int) -> DataFrame:
    """(key, lag, score): the shift within +-most that gives the largest sum of products; ties to the smallest lag."""
    shifted = a.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).select(key, (F.col("pos") + F.col("lag")).alias("pos"), "lag", F.col("v").alias("va"))
    score = shifted.join(b, [key, "pos"]).groupBy(key, "lag").agg(F.sum(F.col("va") * F.col("v")).alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "lag")
    return score.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "lag", "score")


def five_classes(losses: DataFrame, job: str) -> DataFrame:
    """(job, class): the worst of a conversion's losses (job, severity, possible): a loss is inevitable where the target
    could not hold the capability, and only then."""
    rank = F.when(F.col("severity") == "rota", 4).when(F.col("severity") == "ninguna", 0).when(~F.col("possible"), 1).when(F.col("severity") == "leve", 2).otherwise(3)
    names = F.array(*[F.lit(x) for x in ("ÍNTEGRO", "PÉRDIDA INEVITABLE", "DEGRADADO", "DESTRUIDO", "FALLO")])
    return losses.groupBy(job).agg(F.element_at(names, F.max(rank) + 1).alias("class"))


TAGS = ("language", "title")
UNKNOWN = "und"  # a language that says nothing
LOSSLESS_OPTION = ("webp", "avif")  # targets that can keep drawings as they are


def tags_kept(before: DataFrame, after: DataFrame, key: str, track: str) -> DataFrame:
    """(key, severity, lost): whether the tags of tracks (key, track, language, title) are kept. A warning with the tags that were lost or
    changed, in order; informative if all are kept, or if no track of the input has any, when the rule tells nothing. A tag of an
    unknown language may go."""
    x = before.select(key, track, *TAGS).join(after.select(key, track, *[F.col(t).alias(f"_{t}") for t in TAGS]), [key, track], "left")
    some = lambda t: F.coalesce(F.col(t), F.lit("")) != ""
    gone = lambda t: F.when(some(t) & (F.col(t) != UNKNOWN) & ~F.col(t).eqNullSafe(F.col(f"_{t}")), F.concat_ws(" ", F.col(track).cast("string"), F.lit(t)))
    g = x.groupBy(key).agg(F.bool_or(some(TAGS[0]) | some(TAGS[1])).alias("_any"), F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array(*map(gone, TAGS)))))).alias("_lost"))
    lost = F.size("_lost") > 0
    return g.select(key, F.when(lost, "aviso").otherwise("informativo").alias("severity"), F.when(lost, F.array_join("_lost", "; ")).when(~F.col("_any"), "sin etiquetas").alias("lost"))


def palette_rules(drawing: Column, target: Column, lossy: Column, grid: Column) -> list[tuple[str, Column]]:
    """I8: a drawing written with loss to a target that can keep it; V9: a film's palette that is a regular grid, not made from the
    film. Each a rule's name and its severity; an unknown loss counts as one, an unknown palette says nothing."""
    return [
        ("I8", F.when(drawing & target.isin(*LOSSLESS_OPTION) & F.coalesce(lossy, F.lit(True)), "aviso")),
        ("V9", F.when((target == "gif") & grid, "aviso").when((target == "gif") & ~grid, "informativo")),
    ]
