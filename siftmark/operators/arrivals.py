"""Arrivals from listings of folders (poll, ruta, tamano, mtime), in batch: stable files, served once, with patience.

streaming.arrivals does the same with state; these work on a stored table of listings.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import join_small


def stable_runs(listings: DataFrame, polls: int = 2) -> DataFrame:
    """(ruta, tamano, mtime, desde, maduro, n): runs of equal listings of a file; maduro is the poll at which a run has
    been seen `polls` times (null if it never was). Any change begins a new run, and so does a poll that misses the file:
    its state is forgotten. Of rows of one file and poll the latest by mtime, then the largest, counts."""
    w = Window.partitionBy("ruta").orderBy("poll")
    listings = listings.groupBy("ruta", "poll").agg(F.max(F.struct("mtime", "tamano")).alias("_m")).select("ruta", "poll", "_m.tamano", "_m.mtime")
    order = listings.select("poll").distinct().withColumn("_i", F.row_number().over(Window.orderBy("poll")))  # as many rows as polls
    x = listings.join(order, "poll")
    same = (F.lag("tamano").over(w) == F.col("tamano")) & (F.lag("mtime").over(w) == F.col("mtime")) & (F.lag("_i").over(w) == F.col("_i") - 1)
    x = x.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("ruta", "_run").orderBy("poll")))
    return x.groupBy("ruta", "_run", "tamano", "mtime").agg(F.min("poll").alias("desde"), F.min(F.when(F.col("_k") == polls, F.col("poll"))).alias("maduro"), F.count("*").alias("n")).drop("_run")


def runs_of_changes(changes: DataFrame, polled: DataFrame, polls: int = 2) -> DataFrame:
    """stable_runs() of files that each poll lists from their first change on: changes (ruta, hora, tamano, mtime) hold from hora
    until the file's next one, polled (poll) has the polls. The listings themselves, a row for each file and poll, aren't
    made; what is sorted is one row for each change. Runs that no poll falls in are left out."""
    polled = polled.select("poll").where("poll IS NOT NULL").distinct()
    moments = polled.select(F.col("poll").alias("hora"), F.lit(1).alias("_p")).unionByName(changes.select("hora", F.lit(0).alias("_p")).distinct())
    moments = moments.groupBy("hora").agg(F.sum("_p").alias("_p"))  # as many rows as polls and hours of changes
    before = F.sum("_p").over(Window.orderBy("hora").rowsBetween(Window.unboundedPreceding, -1))
    first = moments.select("hora", (F.coalesce(before, F.lit(0)) + 1).alias("_i"))
    order = polled.select("poll", F.row_number().over(Window.orderBy("poll")).cast("long").alias("_i"))
    last = order.agg(F.count("*").alias("_last"))
    x = join_small(changes, first, "hora").crossJoin(F.broadcast(last))
    x = x.withColumn("n", F.coalesce(F.lead("_i").over(Window.partitionBy("ruta").orderBy("hora")), F.col("_last") + 1) - F.col("_i")).where("n > 0")
    x = x.withColumn("_m", F.when(F.col("n") >= polls, F.col("_i") + polls - 1))
    x = join_small(x, order.withColumnRenamed("poll", "desde"), "_i")
    x = join_small(x, order.select(F.col("poll").alias("maduro"), F.col("_i").alias("_m")), "_m", "left")
    return x.select("ruta", "tamano", "mtime", "desde", "maduro", "n")


def numbered(listings: DataFrame) -> DataFrame:
    """listings with vuelta: the number of their poll, from 1, without gaps. As many rows are numbered as there are polls."""
    order = listings.select("poll").distinct().withColumn("vuelta", F.row_number().over(Window.orderBy("poll")).cast("long"))
    return listings.join(order, "poll")


def evictions(listings: DataFrame) -> DataFrame:
    """(ruta, visto, desalojado, polls): each time that a file of listings (vuelta, poll, ruta) is missed: the last poll that had it, the
    first that hasn't, and for how many polls it had been there. The last poll of all ends nothing."""
    once = listings.select("ruta", "vuelta", "poll").distinct()
    w = Window.partitionBy("ruta").orderBy("vuelta")
    runs = once.withColumn("_g", F.col("vuelta") - F.row_number().over(w)).groupBy("ruta", "_g").agg(F.max("vuelta").alias("_v"), F.max("poll").alias("visto"), F.count("*").alias("polls"))
    after = listings.select((F.col("vuelta") - 1).alias("_v"), F.col("poll").alias("desalojado")).distinct()
    return runs.join(after, "_v").select("ruta", "visto", "desalojado", "polls")


def served_once(mature: DataFrame) -> DataFrame:
    """The first time that each identity (ruta, tamano, mtime) matured."""
    return mature.where("maduro IS NOT NULL").groupBy("ruta", "tamano", "mtime").agg(F.min("maduro").alias("servido"))


def with_patience(runs: DataFrame, incomplete: Column, polls: int = 2, patience: int = 3) -> DataFrame:
    """(.., estado): an incomplete file is postponed up to `patience` further polls, then served as given up."""
    return runs.withColumn("estado", F.when(F.col("n") < polls, "pendiente").when(~incomplete, "servido").when(F.col("n") >= polls + patience, "desistido").otherwise("pospuesto"))


def orphans(events: DataFrame, job: str, ts: str, state: str, now: Column, patience_s: int) -> DataFrame:
    """(job, estado): a job whose last state is working and whose last sign of life is too old is closed as failed."""
    g = events.groupBy(job).agg(F.max_by(state, F.struct(ts, "event_id")).alias("_s"), F.max(ts).alias("_t"), F.max(now).alias("_now"))
    dead = (F.col("_s") == "working") & (F.col("_now").cast("timestamp").cast("double") - F.col("_t").cast("timestamp").cast("double") > patience_s)
    return g.select(job, F.when(dead, "failed").otherwise(F.col("_s")).alias("estado"), dead.alias("huerfano"))
