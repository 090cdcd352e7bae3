"""Parts of sets against brute force, and where one property is in all of them."""

import random
import time

from siftmark.operators import similarity as sm


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, p array<string>, q array<string>")


def test_parts_are_those_of_brute_force(spark):
    r = random.Random(5)
    rows = []
    for k in range(250):
        p = r.sample("abcdefghijklmnop", r.randint(0, 9))
        rows.append((k, p + p[:1], r.sample(p, min(len(p), r.randint(0, 2))) + (["z"] if k % 40 == 0 else [])))
    least = {}
    for k, p, q in rows:
        least.setdefault((frozenset(p), frozenset(q)), k)
    want = {(a, b) for (pa, _), a in least.items() for (pb, qb), b in least.items() if pa and pa < pb and qb <= pa}
    for free in (10, 4, 0):
        got = [tuple(x) for x in sm.subsumes(frame(spark, rows), "k", "p", "q", free).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_parts_where_all_sets_share_a_property(spark):
    """12,000 sets around one property: as pairs they would be 144 million."""
    r = random.Random(6)
    rows = [(k, ["all", *(f"w{x}" for x in r.sample(range(300), 4))], ["all"]) for k in range(12_000)]
    began = time.time()
    assert sm.subsumes(frame(spark, [*rows, (12_000, ["all"], [])]), "k", "p", "q").count() == 12_000
    assert time.time() - began < 40
