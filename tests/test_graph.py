"""Plans for requested pairs against all paths, and on a graph as large as that of many engines."""

import random
import time

import pytest
from pyspark.sql import functions as F

from siftmark.operators import graph as gr

EDGES = "origen int, destino int, motor string, estado string, coste double, rasteriza boolean"


def graph(spark, nodes, n, seed, costs=5, raster=0.2):
    r = random.Random(seed)
    rows = {(r.randrange(nodes), r.randrange(nodes), f"m{r.randrange(3)}") for _ in range(n)}
    edges = [(a, b, m, r.choice(["real", "real", "nominal", "sin_sondear"]), float(r.randrange(1, costs)), r.random() < raster) for a, b, m in sorted(rows) if a != b]
    formats = [(i, i % 3 == 0, i % 2 == 0) for i in range(nodes)]
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(formats, "ext int, texto boolean, perdida boolean")


@pytest.mark.parametrize("nodes, n, seed, costs, raster", [(9, 40, 1, 5, 0.2), (14, 60, 2, 50, 0.05), (7, 60, 3, 2, 0.6)])
def test_plans_of_pairs_are_those_of_all_paths(spark, nodes, n, seed, costs, raster):
    edges, formats = graph(spark, nodes, n, seed, costs, raster)
    want = gr.choose(gr.paths(edges, formats))
    asked = gr.first_hops(edges.where("estado <> 'nominal'"), 4).select("origen", F.col("destino").alias("final"))
    got = gr.choose(gr.paths_between(asked, edges, formats))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    one = asked.limit(3)
    assert sorted(map(tuple, gr.choose(gr.paths_between(one, edges, formats)).collect())) == sorted(map(tuple, want.join(one, ["origen", "final"], "left_semi").collect()))
    assert gr.paths_between(asked.where("false"), edges, formats).collect() == []


def test_closure_by_new_pairs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(40, 20), (50, 51), (51, 50)]
    got = {tuple(r) for r in gr.closure(spark.createDataFrame(edges, "origen int, destino int")).collect()}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    want = set()
    for a in out:
        seen, front = set(), [a]
        while front:
            for y in out.get(front.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    front.append(y)
        want |= {(a, y) for y in seen if y != a}
    assert got == want


def test_plans_in_a_large_graph(spark):
    """1,000 formats, 100,000 edges: all paths of four hops would be some 10**11."""
    edges, formats = graph(spark, 1000, 100_000, 7, 100, 0.1)
    asked = spark.createDataFrame([(i, (7 * i + 3) % 1000) for i in range(0, 1000, 50)], "origen int, final int")
    began = time.time()
    plans = gr.choose(gr.paths_between(asked, edges, formats)).collect()
    assert time.time() - began < 90
    chosen = [r for r in plans if r["rango"] == 1]
    assert len(chosen) == 20 and all(r["nodos"].startswith(f"{r['origen']}>") and r["nodos"].endswith(f">{r['final']}") and len(set(r["nodos"].split(">"))) == r["saltos"] + 1 for r in plans)


def test_added_paths_keep_their_rank(spark):
    """Of a pair with ten paths, of which only the dearest rasterises: it is the tenth, not the ninth."""
    edges = [(0, i, "m", "real", float(i), False) for i in range(1, 11)] + [(i, 99, "m", "real", 1.0, i == 10) for i in range(1, 11)]
    formats = spark.createDataFrame([(i, i == 99, False) for i in range(100)], "ext int, texto boolean, perdida boolean")
    got = gr.choose(gr.paths(spark.createDataFrame(edges, EDGES), formats), ranked=True).where("origen = 0 and final = 99").collect()
    assert sorted((r["rango"], r["nodos"]) for r in got)[-2:] == [(8, "0>8>99"), (10, "0>10>99")] and len(got) == 9
