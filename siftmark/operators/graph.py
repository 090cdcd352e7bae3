"""Routes through a graph of conversions: costs, reach, simple paths, choice and reasons.

Edges are (origen, destino, motor, estado, coste, rasteriza); formats are (ext, texto, perdida). The graph's size
is that of the installed engines, not of the data. Plans are made for requested pairs (paths_between); all paths of all pairs
(paths) are for small graphs.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import cut, join_small, written

# What rasterising before a text format costs, what each lossy write after the first, an unprobed edge.
RASTER, LOSSY, UNPROBED = 1000.0, 4.0, 2.0
MOST_HOPS, CANDIDATES = 4, 8


def build_edges(engines: DataFrame) -> DataFrame:
    """Edges of engines (motor, ext, lee, escribe): each input with each output of the same engine, no loops."""
    i = engines.where("lee").select("motor", F.col("ext").alias("origen"))
    o = engines.where("escribe").select("motor", F.col("ext").alias("destino"))
    return i.join(o, "motor").where("origen <> destino")


def step_cost(final_holds_text: Column) -> Column:
    """An edge's cost on the way to a final format; dead edges are filtered out before."""
    return F.col("coste") + F.when(F.col("rasteriza") & final_holds_text, RASTER).otherwise(0.0) + F.when(F.col("estado") == "sin_sondear", UNPROBED).otherwise(0.0)


def first_hops(edges: DataFrame, most: int) -> DataFrame:
    """(origen, destino, saltos): the number of hops at which each pair is first reached. Each level joins the new
    pairs only and drops what is known, so work follows the pairs, not the walks."""
    e = edges.select("origen", "destino").distinct()
    reached = e.select("origen", "destino", F.lit(1).alias("saltos"))
    new = reached
    for k in range(2, most + 1):
        step = new.select("origen", F.col("destino").alias("via")).join(e.select(F.col("origen").alias("via"), "destino"), "via")
        new = step.where("origen <> destino").select("origen", "destino").distinct().join(reached.select("origen", "destino"), ["origen", "destino"], "left_anti").withColumn("saltos", F.lit(k))
        reached = reached.unionByName(new)
    return reached


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """(origen, destino): all pairs that any number of hops joins. Each round joins what was new in the last one with all that
    is known, so paths double in length and no pair is joined with the same pair twice."""
    kept = lambda x: written(x, "closure")[0]  # noqa: E731  checkpoints carry constraints that Spark 4.1 can't rewrite in unions
    pairs = new = kept(edges.select("origen", "destino").distinct())
    far = lambda x: x.select(F.col("origen").alias("destino"), F.col("destino").alias("far"))
    for _ in range(most):
        step = new.join(far(pairs), "destino").select("origen", F.col("far").alias("destino")).union(pairs.join(far(new), "destino").select("origen", F.col("far").alias("destino")))
        new = kept(step.distinct().join(pairs, ["origen", "destino"], "left_anti"))
        if new.isEmpty():
            break
        pairs = pairs.union(new)
    return pairs.where("origen <> destino")


def paths(edges: DataFrame, formats: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(origen, final, nodos, saltos, coste, rasteriza, pena): all simple paths of live edges up to `most` hops.

    Written as unrolled joins with the cycle test in each, so Catalyst prunes before every expansion. coste holds steps
    at the final format's prices and the penalty for lossy writes after the first.
    """
    e = edges.where("estado <> 'nominal'").join(formats.select(F.col("ext").alias("destino"), "perdida"), "destino", "left")
    plain = F.col("coste") + F.when(F.col("estado") == "sin_sondear", UNPROBED).otherwise(0.0)
    e = e.select("origen", "destino", "motor", plain.alias("c"), F.col("rasteriza").cast("int").alias("r"), F.coalesce("perdida", F.lit(False)).cast("int").alias("p"))
    level = e.select("origen", F.col("destino").alias("final"), F.array("origen", "destino").alias("nodos"), F.array("motor").alias("motores"), F.col("c").alias("c"), F.col("r").alias("r"), F.col("p").alias("p"))
    out = level
    for _ in range(most - 1):
        nxt = e.select(F.col("origen").alias("final"), F.col("destino").alias("next"), "motor", F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("p").alias("p2"))
        level = level.join(nxt, "final").where(~F.array_contains("nodos", F.col("next")))
        level = level.select("origen", F.col("next").alias("final"), F.array_append("nodos", F.col("next")).alias("nodos"), F.array_append("motores", F.col("motor")).alias("motores"), (F.col("c") + F.col("c2")).alias("c"), (F.col("r") + F.col("r2")).alias("r"), (F.col("p") + F.col("p2")).alias("p"))
        out = out.unionByName(level)
    holds = formats.select(F.col("ext").alias("final"), F.coalesce("texto", F.lit(False)).alias("texto"))
    out = out.join(holds, "final", "left").withColumn("texto", F.coalesce("texto", F.lit(False)))
    pena = LOSSY * F.greatest(F.lit(0), F.col("p") - 1)
    cost = F.col("c") + F.when(F.col("texto"), F.col("r") * RASTER).otherwise(0.0) + pena
    return out.select("origen", "final", F.array_join(F.transform("nodos", lambda x: x.cast("string")), ">").alias("nodos"), F.array_join("motores", ",").alias("motores"), (F.size("motores")).alias("saltos"), cost.alias("coste"), (F.col("r") > 0).alias("rasteriza"), pena.alias("pena"), "texto")


def _live(edges: DataFrame, formats: DataFrame) -> DataFrame:
    """Live edges (origen, destino, motor, c, r, p): plain cost, whether they rasterise, whether they write with loss."""
    e = join_small(edges.where("estado <> 'nominal'"), formats.select(F.col("ext").alias("destino"), "perdida"), "destino", "left")
    plain = F.col("coste") + F.when(F.col("estado") == "sin_sondear", UNPROBED).otherwise(0.0)
    return e.select("origen", "destino", "motor", plain.cast("double").alias("c"), F.col("rasteriza").cast("int").alias("r"), F.coalesce("perdida", F.lit(False)).cast("int").alias("p"))


def paths_between(requests: DataFrame, edges: DataFrame, formats: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """What paths() gives for requested pairs (origen, final), less paths that choose(k) wouldn't return: simple paths of up to four hops.

    Two halves of up to two hops meet in the middle. The k-th cheapest path of one or two hops, and the cheapest rasterising one, are
    bounds; a middle counts only if the cheapest halves that meet there are within them, and so do halves and paths. The
    penalty for lossy writes isn't negative, so leaving it out of a half's cost can't hide a path.
    """
    e = cut(_live(edges, formats))
    asked = join_small(requests.select("origen", "final").distinct().where("origen <> final"), formats.select(F.col("ext").alias("final"), F.coalesce("texto", F.lit(False)).alias("texto")), "final", "left")
    asked = cut(asked.select("origen", "final", F.coalesce("texto", F.lit(False)).alias("texto")))
    one = e.select(F.col("origen").alias("o"), F.col("destino").alias("y"), F.array("origen", "destino").alias("n"), F.array("motor").alias("m"), "c", "r", "p")
    onward = e.select(F.col("origen").alias("y"), F.col("destino").alias("z"), "motor", F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("p").alias("p2"))

    def longer(x: DataFrame) -> DataFrame:
        x = x.join(onward, "y").where(F.col("z") != F.col("o"))
        return x.select("o", F.col("z").alias("y"), F.array_append("n", F.col("z")).alias("n"), F.array_append("m", F.col("motor")).alias("m"), (F.col("c") + F.col("c2")).alias("c"), (F.col("r") + F.col("r2")).alias("r"), (F.col("p") + F.col("p2")).alias("p"))

    firsts = one.join(asked.select(F.col("origen").alias("o")).distinct(), "o", "left_semi")
    two = cut(longer(firsts))
    ends = asked.select(F.col("final").alias("y")).distinct()
    last_one = one.join(ends, "y", "left_semi")
    before = e.select(F.col("destino").alias("o"), F.col("origen").alias("w"), "motor", F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("p").alias("p2"))
    last_two = last_one.join(before, "o").where(F.col("w") != F.col("y")).select(F.col("w").alias("o"), "y", F.concat(F.array("w"), "n").alias("n"), F.concat(F.array("motor"), "m").alias("m"), (F.col("c") + F.col("c2")).alias("c"), (F.col("r") + F.col("r2")).alias("r"), (F.col("p") + F.col("p2")).alias("p"))
    tail = cut(last_one.unionByName(last_two))

    price = lambda c, r: c + F.when(F.col("texto"), r * RASTER).otherwise(0.0)
    pena = lambda p: LOSSY * F.greatest(F.lit(0), p - 1)
    short = firsts.unionByName(two).withColumnsRenamed({"o": "origen", "y": "final"}).join(asked, ["origen", "final"])
    short = cut(short.withColumn("coste", price(F.col("c"), F.col("r")) + pena(F.col("p"))))
    rank = F.row_number().over(Window.partitionBy("origen", "final").orderBy("coste"))
    bound = short.withColumn("_k", rank).groupBy("origen", "final").agg(F.max(F.when(F.col("_k") == k, F.col("coste"))).alias("_all"), F.min(F.when(F.col("r") > 0, F.col("coste"))).alias("_ras"))
    never = float("inf")
    limits = asked.join(bound, ["origen", "final"], "left").select("origen", "final", "texto", F.coalesce("_all", F.lit(never)).alias("_all"), F.coalesce("_ras", F.lit(never)).alias("_ras"))

    def least(x: DataFrame, names: str) -> DataFrame:
        """The cheapest halves between two nodes: at the prices of targets with and without text, and of those that rasterise."""
        text = F.col("c") + F.col("r") * RASTER
        return x.groupBy("o", "y").agg(*[F.min(v).alias(f"{names}{n}") for n, v in (("0", F.col("c")), ("1", text), ("r0", F.when(F.col("r") > 0, F.col("c"))), ("r1", F.when(F.col("r") > 0, text)))])

    heads, tails = least(two, "h").withColumnsRenamed({"o": "origen", "y": "mid"}), least(tail, "t").withColumnsRenamed({"o": "mid", "y": "final"})
    of = lambda n: F.when(F.col("texto"), F.col(f"{n}1")).otherwise(F.col(f"{n}0"))
    mids = limits.join(heads, "origen").join(tails, ["mid", "final"])
    ras = F.least(of("hr") + of("t"), of("h") + of("tr"))
    mids = mids.where((of("h") + of("t") <= F.col("_all")) | F.coalesce(ras <= F.col("_ras"), F.lit(False)))
    mids = cut(mids.select("origen", "final", "mid", "texto", "_all", "_ras", of("h").alias("_h"), of("t").alias("_t")))
    side = lambda x, o, y, i: x.select(F.col("o").alias(o), F.col("y").alias(y), *[F.col(c).alias(f"{c}{i}") for c in "nmcrp"])
    most = F.greatest("_all", "_ras")
    met = mids.join(side(two, "origen", "mid", 1), ["origen", "mid"]).where(price(F.col("c1"), F.col("r1")) + F.col("_t") <= most)
    met = met.join(side(tail, "mid", "final", 2), ["mid", "final"]).where(F.size(F.array_intersect("n1", "n2")) == 1)
    met = met.select("origen", "final", "texto", "_all", "_ras", F.concat("n1", F.slice("n2", F.lit(2), F.size("n2") - 1)).alias("n"), F.concat("m1", "m2").alias("m"), (F.col("c1") + F.col("c2")).alias("c"), (F.col("r1") + F.col("r2")).alias("r"), (F.col("p1") + F.col("p2")).alias("p"))
    met = met.withColumn("coste", price(F.col("c"), F.col("r")) + pena(F.col("p"))).where((F.col("coste") <= F.col("_all")) | ((F.col("r") > 0) & (F.col("coste") <= F.col("_ras"))))
    out = short.unionByName(met, allowMissingColumns=True)
    return out.select("origen", "final", F.array_join(F.transform("n", lambda x: x.cast("string")), ">").alias("nodos"), F.array_join("m", ",").alias("motores"), F.size("m").alias("saltos"), "coste", (F.col("r") > 0).alias("rasteriza"), pena(F.col("p")).alias("pena"), "texto")


def choose(all_paths: DataFrame, k: int = CANDIDATES, ranked: bool = False) -> DataFrame:
    """The k cheapest paths of each pair, and the cheapest rasterising one if it isn't among them; rank 1 is the choice,
    the others carry the reason why they were rejected; the added one has rank k + 1, or if ranked its own among all_paths, which
    must be all there are. Ties by hops, then by the path's text, then its engines."""
    order = ["coste", "saltos", "nodos", "motores"]
    w = Window.partitionBy("origen", "final").orderBy(*order)
    x = all_paths.withColumn("rango", F.row_number().over(w)).withColumn("_r", F.row_number().over(Window.partitionBy("origen", "final", "rasteriza").orderBy(*order)))
    x = x.where((F.col("rango") <= k) | (F.col("rasteriza") & (F.col("_r") == 1)))
    first = x.where("rango = 1").select("origen", "final", F.col("saltos").alias("s1"), F.col("rasteriza").alias("r1"), F.col("pena").alias("p1"))
    x = x.join(first, ["origen", "final"])
    reason = F.when(F.col("rango") == 1, F.when(F.col("rasteriza") & F.col("texto"), "unico: rasteriza").otherwise("elegido"))
    reason = reason.when(F.col("rasteriza") & ~F.col("r1") & F.col("texto"), "rasteriza").when(F.col("saltos") < F.col("s1"), F.when(F.col("pena") > F.col("p1"), "mas corto, mas perdidas").otherwise("mas corto, mas caro")).otherwise("mas caro")
    return x.select("origen", "final", (F.col("rango") if ranked else F.least("rango", F.lit(k + 1))).alias("rango"), "nodos", "motores", "saltos", "coste", "rasteriza", reason.alias("motivo"))


def why_not(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """(origen, destino, motivo) of requests without a path: nothing reads the source, nothing writes the target, or
    only from formats that aren't reached over live edges; with the number of dead edges to the target."""
    live = closure(edges.where("estado <> 'nominal'"))
    reads, writes = edges.select("origen").distinct(), edges.groupBy("destino").agg(F.count_if(F.col("estado") == "nominal").alias("muertas"))
    r = requests.join(reads.withColumn("lee", F.lit(True)), "origen", "left").join(writes.withColumn("escribe", F.lit(True)), "destino", "left")
    r = r.join(live.withColumn("llega", F.lit(True)), ["origen", "destino"], "left").where("llega IS NULL AND origen <> destino")
    return r.select("origen", "destino", F.when(F.col("lee").isNull(), "nadie lee").when(F.col("escribe").isNull(), "nadie escribe").otherwise("inalcanzable").alias("motivo"), F.coalesce("muertas", F.lit(0)).alias("muertas"))


def loss_cost(paths_: DataFrame, path: str, weights: DataFrame) -> DataFrame:
    """(path, semantica, metrica, riesgo, coste, aceptable) from losses (path, perdida, valor) and weights (perdida, clase,
    peso): sums by class; 500 and more is refused."""
    x = join_small(paths_, weights, "perdida")
    part = lambda c: F.sum(F.when(F.col("clase") == c, F.col("peso") * F.col("valor")).otherwise(0.0)).alias(c)
    g = x.groupBy(path).agg(part("semantica"), part("metrica"), part("riesgo"))
    total = F.col("semantica") + F.col("metrica") + F.col("riesgo")
    return g.select(path, *[F.round(c, 5).alias(c) for c in ("semantica", "metrica", "riesgo")], F.round(total, 5).alias("coste"), (total < 500).alias("aceptable"))


def guarded_probes(probes: DataFrame, installed: DataFrame) -> DataFrame:
    """(motor, estado, partes, nota, vale): which probes of engines still hold for what is installed.

    Both sides are (motor, build, interprete, huella: map of parts). Guards in order: another build, another interpreter, parts of the fingerprint
    that both sides have and that differ. What a probe doesn't declare isn't held against it, but noted. An engine that isn't
    installed has no valid probe.
    """
    now = installed.select("motor", F.col("build").alias("_b"), F.col("interprete").alias("_i"), F.col("huella").alias("_h"), F.lit(True).alias("_there"))
    x = probes.join(now, "motor", "left")
    off = F.array_sort(F.map_keys(F.map_filter("huella", lambda k, v: F.element_at("_h", k).isNotNull() & ~F.element_at("_h", k).eqNullSafe(v))))
    none = F.coalesce(F.size("huella"), F.lit(0)) <= 0
    state = F.when(F.col("_there").isNull(), "sin_instalar").when((F.col("build") != "") & (F.col("build") != F.col("_b")), "build_distinto").when((F.col("interprete") != "") & ~F.col("interprete").eqNullSafe(F.col("_i")), "interprete_distinto")
    state = state.when(~none & (F.size(off) > 0), "caducada").otherwise("valida")
    note = F.concat_ws(",", F.when(F.coalesce("interprete", F.lit("")) == "", "sin_interprete"), F.when(none, "sin_huella"))
    return x.select("motor", state.alias("estado"), F.when(state == "caducada", F.array_join(off, ",")).alias("partes"), F.when(state == "valida", note).alias("nota"), (state == "valida").alias("vale"))
