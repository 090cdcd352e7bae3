"""The operators for training data against brute force, exact round trips, or held-out labels; and awkward rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from siftmark.llm import ann, bpe, common, hamming, lines, merkle, mixing, quality, queries, secrets, sharding, simhash, warc

SF = "/root/testdata/sf0.001"
INSIDE = ("fp", "key", "row", "line", "node", "_key", "_lines", "_row", "_id", "_again", "_epochs", "_cut", "_time", "_group", "_source", "_target", "log_weight", "slot", "bucket", "extra", "a", "b", "m")
DOCS = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in INSIDE)


def docs_of(spark, rows):
    """Rows (doc_id, text[, source]) with extra columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", None, *["x"] * len(INSIDE)) for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward():
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [(1, None), (2, ""), (3, "   \n\n"), (4, "one"), (4, "one"), (None, "no id but words here to see"), (None, None), (5, long), (6, long), (7, "é" * 5000), (8, "\0 odd \t text"), (9, "same words in this line\nsame words in this line")]


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


# --- shared ---


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7)] + [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(250)]
    got = {x["node"]: x["root"] for x in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    group = defaultdict(list)
    for x, g in zip(nodes, union_find(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])):
        group[g].append(x)
    assert got == {x: min(v) for v in group.values() for x in v}
    hubs = {x["node"]: x["root"] for x in common.connected_components(spark.createDataFrame(edges, "a long, b long"), hub=5).collect()}
    assert hubs == got
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("blocks,most", [(4, 4096), (5, 16), (6, 3)])
def test_close_forest_loses_no_group(spark, blocks, most):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    fps = list(base)
    for f in base[:30]:
        for _ in range(12):
            g = int(f)
            for b in r.integers(0, 64, r.integers(1, 6)):
                g ^= 1 << int(b)
            fps.append(np.uint64(g))
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {(x["a"], x["b"]) for x in hamming.close_forest(df, 3, blocks, most).collect()}
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    assert all(int(fps[at[a]] ^ fps[at[b]]).bit_count() <= 3 for a, b in got)
    close = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    same = lambda x: frozenset(frozenset(i for i in range(len(fps)) if x[i] == k) for k in set(x))
    assert same(union_find(len(fps), close)) == same(union_find(len(fps), [(at[a], at[b]) for a, b in got]))


# --- 1 quality ---


def test_labels_that_were_not_seen_agree(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    kept = {r["doc_id"] for r in quality.resample(d, train)[0].collect()}
    rows = held.collect()
    clean = [r["doc_id"] in kept for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["doc_id"] in kept for r in rows if r["quality"] == 0]
    assert sum(clean) / len(clean) > 0.75 and sum(junk) / len(junk) < 0.1


def test_gumbel_top_k_is_exact(spark):
    r = random.Random(2)
    keys = [r.choice([r.randint(-(10**9), 10**9), 5, 6, 7]) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 77, 499, 500):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]


def test_gumbel_noise_has_its_distribution(spark):
    x = [r[0] / 1e6 for r in spark.range(20_000).select(quality.noisy(F.lit(0.0), F.col("id"))).collect()]
    assert abs(np.mean(x) - 0.5772) < 0.03 and abs(np.std(x) - math.pi / 6**0.5) < 0.03


def test_quality_takes_awkward_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (9, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    d = docs_of(spark, awkward())
    out = quality.keep_target_like(d, labels, k=6)
    assert out.columns == d.columns and 6 <= out.count() <= len(awkward())
    assert quality.keep_target_like(d, labels.limit(0)).count() == 0
    assert quality.keep_target_like(d.limit(0), labels).count() == 0


def test_models_weights_and_k_equal_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    groups = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.group_of(docs).alias("g")).collect()}
    said = defaultdict(lambda: [1, 0])
    for r in labels.collect():
        said[r["doc_id"]] = [min(said[r["doc_id"]][0], r["quality"]), max(said[r["doc_id"]][1], r["toxic"])]
    good = {k for k, (q, t) in said.items() if q == 1 and t == 0}

    def mixed(h):
        return ((h ^ (h >> 29)) * 0x165667B19E3779F9) % 2**64

    def buckets(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
        two = [1 if a == b else (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 for a, b in zip(h, h[1:])]
        return [x >> (64 - quality.BITS) for x in [*h, *map(mixed, two)]]

    grams = {r["doc_id"]: Counter((groups[r["doc_id"]], b) for b in buckets(r["text"])) for r in docs.collect()}
    raw, target, sums = Counter(), Counter(), [Counter(), Counter()]
    for k, c in grams.items():
        raw.update(c)
        if k in good:
            target.update(c)
    for (g, _), n in raw.items():
        sums[0][g] += n
    for (g, _), n in target.items():
        sums[1][g] += n
    ratio = {x: math.log((target[x] + quality.PRIOR) / (n / sums[0][x[0]] * sums[1][x[0]] + quality.PRIOR)) for x, n in raw.items()}
    weight = {k: sum(ratio[x] * n for x, n in c.items()) for k, c in grams.items()}
    share = len(good) / len(said)
    k = round(sum(min(1.0, share * math.exp(min(w, 50.0))) for w in weight.values()))

    def key(doc_id):
        u = (int(hashlib.md5(f"gumbel|0|{doc_id}".encode()).hexdigest()[:15], 16) + 0.5) / 2**60
        return weight[doc_id] - math.log(-math.log(u))

    want = set(sorted(weight, key=key)[-k:])
    got = {r["doc_id"]: r["log_weight"] for r in queries.op1_importance_resampling(spark, SF).collect()}
    assert got.keys() == want and all(abs(v - weight[i]) < 1e-6 for i, v in got.items())


# --- 2 WARC ---


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, n int, first int")


def test_archives_round_trip_and_salvage(spark, tmp_path):
    body = "x" * 200
    rows = [(3, "http://a/\r\nb", body, "d", 1, 1), (1, None, body, "d", 1, 1), (1, "u", body, "d", 1, 1), (2, "u", "short", "d", 1, 1), (5, "u", "short", "d", 1, 1), (6, "u", None, "d", 1, 1), (7, "u", "WARC/1.1\r\n\r\nñ" + "y" * 300_000, "d", 1, 1), (None, "u", body, "d", 1, 1)]
    for compressed in (True, False):
        at = f"{tmp_path}/{compressed}"
        warc.write_archives(pages(spark, rows).coalesce(1), at, compressed)
        archive = warc.read_archives(spark, at)
        got = Counter((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.records(archive).collect())
        want = Counter()
        for page, _, html, *_ in rows:
            data = (html or "").encode()
            revisit = html == body and page != 1
            want[(f"<urn:page:{'null' if page is None else page}>", "revisit" if revisit else "response", "<urn:page:1>" if revisit else None, len(data), hashlib.sha256(data).hexdigest())] += 1
        assert got == want and warc.gaps(archive).count() == 0 and warc.lost_revisits(archive).count() == 0
    warc.write_archives(pages(spark, []), f"{tmp_path}/none")
    assert warc.records(warc.read_archives(spark, f"{tmp_path}/none")).count() == 0


def record(i, payload, text=False):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
    raw = head.encode() + block + b"\r\n\r\n"
    if text:
        return raw
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


@pytest.mark.parametrize("plain", [False, True])
def test_damage_costs_one_record_and_is_logged(plain):
    r = random.Random(4)
    parts = [record(i, r.randbytes(400) + b"WARC/1.1\r\nnot a record", plain) for i in range(12)]
    begin = [sum(map(len, parts[:i])) for i in range(13)]
    for trial in range(40):
        hit = r.randrange(12)
        data = bytearray(b"".join(parts))
        if trial % 4 == 0:  # bytes go missing
            cut = begin[hit] + r.randrange(30, len(parts[hit]) - 30)
            del data[cut : cut + r.randrange(1, 20)]
        elif trial % 4 == 1:  # junk comes in between
            data[begin[hit] : begin[hit]] = b"\x1f\x8b\x08 junk WARC/1.0\r\n" + r.randbytes(9)
        else:
            for _ in range(3):
                data[begin[hit] + r.randrange(len(parts[hit]))] ^= 1 + r.randrange(255)
        found = list(warc.salvage(bytes(data)))
        ids = {x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)}
        assert {f"<{i}>" for i in range(12) if i != hit} <= ids
        pos = 0
        for x in found:  # records and gaps cover the file without overlap
            assert x.start == pos
            pos = x.end
        assert pos == len(data)
    assert list(warc.salvage(b"")) == [] and [type(x) for x in warc.salvage(b"rubbish")] == [warc.Gap]


def test_nothing_is_too_long_and_files_roll_by_bytes(spark, tmp_path):
    rows = [(i, "u" * (2 << 20) if i == 3 else "u", ("%d " % i) * (200_000 if i % 7 == 0 else 40), "d", 1, 1) for i in range(60)]
    for compressed in (True, False):
        at = f"{tmp_path}/{compressed}"
        warc.write_archives(pages(spark, rows).coalesce(1), at, compressed, file_bytes=1 << 20)
        archive = warc.read_archives(spark, at, with_payload=False)
        assert {r["record_id"]: r["payload_bytes"] for r in warc.records(archive, whole=True).collect()} == {f"<urn:page:{i}>": len(h) for i, _, h, *_ in rows}
        files = archive.groupBy("file").agg(F.sum("payload_bytes").alias("n"), F.count("*").alias("records")).collect()
        assert len(files) > 5 and all(f["n"] <= 1 << 20 or f["records"] == 1 for f in files)


def test_a_gap_fails_those_who_want_all(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1, b"x" * 50, True) + b"rubbish" + record(2, b"y" * 50, True))
    archive = warc.read_archives(spark, str(tmp_path))
    assert warc.records(archive).count() == 2 and warc.gaps(archive).count() == 1
    with pytest.raises(Exception, match="gap in"):
        warc.records(archive, whole=True).collect()


def test_salvage_takes_time_in_proportion():
    def damaged(n):  # every second length is wrong, and no member's mark occurs
        return b"".join(record(i, b"p" * 300, True).replace(b"Content-Length: 3", b"Content-Length: 9" if i % 2 else b"Content-Length: 3") for i in range(n))

    took = []
    for n in (8000, 16000, 32000):
        data, began = damaged(n), time.perf_counter()
        assert sum(isinstance(x, warc.Record) for x in warc.salvage(data)) == n // 2
        took.append(time.perf_counter() - began)
    assert took[2] < 3 * took[1] and took[2] < 6 * took[0]


# --- 3 SimHash ---


def slow_fingerprint(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_equal_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()] + [x for x in awkward() if x[0] is None or x[0] != 5]
    got = sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, rows), 3).collect()), key=str)
    fp = [slow_fingerprint(t, 3) for _, t in rows]
    group = defaultdict(list)
    for i, g in enumerate(union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])):
        group[g].append(i)
    least = {i: min([rows[k][0] for k in v if rows[k][0] is not None], default=None) for v in group.values() for i in v}
    assert got == sorted(((rows[i][0], fp[i], least[i]) for i in range(len(rows))), key=str)


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text), (9, text + " more"), (4, "other words altogether"), (None, text), (3, text)]
    out = simhash.drop_near_duplicates(docs_of(spark, rows))
    assert sorted((str(r["doc_id"]) for r in out.collect())) == ["3", "3", "4", "None"]
    assert simhash.drop_near_duplicates(docs_of(spark, [])).count() == 0


# --- 4 sharding ---


def test_table_is_even_and_moves_little():
    names = [f"s{i}" for i in range(20)]
    t = sharding.lookup_table(names, 2003)
    n = Counter(t)
    assert max(n.values()) - min(n.values()) <= 1 and set(t) == set(range(20))
    fewer = sharding.lookup_table(names[:-1], 2003)
    assert sum(a != b for a, b in zip(t, fewer) if a != 19) < 0.25 * 2003
    w = Counter(sharding.lookup_table(["a", "b", "c"], 2003, [3, 1, 0]))
    assert w[2] == 0 and abs(w[0] - 3 * w[1]) <= 4
    for bad in (([], 7), (["a"], 8), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_every_row_is_placed(spark):
    d = docs_of(spark, awkward()).withColumn("slot", F.lit("x"))
    got = sharding.place(d, ["doc_id"], ["a", "b", "c"], 101).collect()
    assert len(got) == len(awkward()) and len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    spread = sharding.place(spark.range(900).withColumn("k", F.lit(1)), ["k"], ["a", "b", "c"], 101, spread=["id"])
    assert spread.groupBy("shard").count().count() == 3


# --- 5 mixing ---


def test_exponent_meets_the_limit(spark):
    sizes = spark.createDataFrame([("a", 10, 8000), ("b", 10, 1500), ("c", 10, 500), ("empty", 3, 0)], "key string, n_docs long, n_tokens long")
    got = {r["key"]: r for r in mixing.weights(sizes, max_repeats=2.0).collect()}
    assert set(got) == {"a", "b", "c"}
    assert abs(got["c"]["weight"] * 10_000 / 500 - 2) < 1e-3 and abs(sum(r["weight"] for r in got.values()) - 1) < 1e-6
    h = [r["weight"] for r in mixing.weights(sizes, max_repeats=None, target_entropy=0.9).collect()]
    assert abs(-sum(w * math.log(w) for w in h) - 0.9) < 1e-4


def test_stream_keeps_quota_and_proportions(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(1, 40)), "big" if i % 5 else "small") for i in range(3000)]
    rows += [(1, "w w", None), (None, "w", "small"), (4, "", "big"), (5, None, "hollow")]
    d = docs_of(spark, rows)
    got = mixing.mix(d, max_repeats=1.5, block_tokens=5000).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    plan = {("n" if k is None else "v" + k): v for k, v in size.items()}
    quota = {r["key"]: r["quota"] for r in mixing.weights(spark.createDataFrame([(k, 1, v) for k, v in plan.items()], "key string, n_docs long, n_tokens long"), max_repeats=1.5).collect()}
    took = Counter()
    for x in got:
        took["n" if x["source"] is None else "v" + x["source"]] += x["n_tokens"]
    for k, q in quota.items():
        assert q - 40 <= took[k] <= q
    blocks = defaultdict(Counter)
    for x in got:
        blocks[x["mix_block"]][x["source"]] += x["n_tokens"]
    share = took["vsmall"] / sum(took.values())
    assert all(abs(b["small"] / sum(b.values()) - share) < 0.05 for b in blocks.values())
    times = Counter((r["source"], r["doc_id"]) for r in got)
    whole = Counter((r["source"], r["doc_id"]) for r in mixing.mixed_documents(d, max_repeats=1.5).collect())
    assert times == whole
    assert mixing.mix(docs_of(spark, [])).count() == 0 and mixing.mixed_documents(docs_of(spark, [])).count() == 0


def test_documents_come_as_often_as_the_stream_takes_them(spark):
    r = random.Random(11)
    rows = [(i, " ".join(["w"] * r.randint(1, 9)), "big") for i in range(300)]
    rows += [(None, f"row {i} of nobody", "small") for i in range(50)] + [(7, f"text {i} of seven", "seven") for i in range(40)] + [(8, "equal in all", "equal")] * 30
    d = docs_of(spark, rows).cache()
    for seed in range(10):
        want = Counter((x["source"], x["doc_id"]) for x in mixing.mix(d, max_repeats=2.5, seed=seed).collect())
        got = Counter((x["source"], x["doc_id"]) for x in mixing.mixed_documents(d, max_repeats=2.5, seed=seed).collect())
        assert got == want


def test_equal_sources_weigh_alike(spark):
    many = [(f"k{i}", 1, 10 + i % 3) for i in range(3000)] + [("most", 9, 500_000)]
    got = {x["key"]: x["weight"] for x in mixing.weights(spark.createDataFrame(many, "key string, n_docs long, n_tokens long"), max_repeats=None, target_entropy=5.0).collect()}
    assert abs(-sum(w * math.log(w) for w in got.values()) - 5.0) < 1e-2 and len({round(v, 9) for v in got.values()}) == 4


# --- 6 Merkle ---


def test_likeness_equals_counted_pieces(spark):
    """Likeness against its definition by plain counting, without trees."""
    r = random.Random(12)
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()] + [(9000, None), (9001, ""), (9002, "\n\n"), (9003, "a. b! c?\n" * 50)]
    rows.sort()
    want = {}

    def likeness(a, b):
        if a == b:
            return 1.0
        p, q = (Counter(x for line in t.split("\n") for x in merkle.PIECE.findall(line)) for t in (a, b))
        return 2 * (p & q).total() / (p.total() + q.total()) if p or q else 0.0

    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        want[k] = (likeness(t, t[: len(t) - half] + after[:half]), likeness(t, after))
    got = {x["doc_id"]: (x["near_edited"], x["near_next"]) for x in merkle.against_edits(docs_of(spark, r.sample(rows, len(rows)))).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-12 for k in want for a, b in zip(got[k], want[k]))


def test_edits_and_order_equal_brute_force(spark):
    rows = [x for x in awkward() if x[0] is not None] + [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = merkle.against_edits(docs_of(spark, rows), buckets=8).collect()
    order = sorted(rows, key=lambda x: (x[0], x[1] or ""))
    want = Counter()
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want[(k, len(t), hashlib.sha256(new.encode()).hexdigest(), merkle.grow(t).root.hex(), merkle.grow(new).root.hex())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    big = [r for r in got if r["n_chars"] > 400 and r["fingerprint"] != r["edited_fingerprint"]]
    assert sum(r["near_edited"] > 0.3 for r in big) > 0.9 * len(big)
    assert merkle.against_edits(docs_of(spark, [])).count() == 0
    assert merkle.against_edits(docs_of(spark, [(None, "a b"), (None, None)])).count() == 2


def test_roots_tell_texts_and_branches_tell_edits():
    a = merkle.grow("first\nsecond line\nthird. And more")
    b = merkle.grow("first\nsecond lime\nthird. And more")
    near, changed = merkle.compare(a, b, 4, 4)
    assert a.root != b.root and changed == [1] and 0.5 < near < 1
    assert merkle.compare(a, merkle.grow("first\nsecond line\nthird. And more"), 4, 4) == (1.0, [])
    assert merkle.grow("x\n").root != merkle.grow("x").root


# --- 7 secrets ---


def test_spans_equal_plain_regular_expressions(spark):
    r = random.Random(6)
    bits = ["password", "passwd=", "Secret: ", "tokentoken=", "api_key", "APIKEY='", "=", ": ", '"', "AKIA", "akia", "ABCDEF0123456789ABCD", "0123456789abcdef", "deadbeef", " ", "\n", "é", "İ", "ſecret=", "abcdefghijkl", "/+._-"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(400)] + awkward()
    got = secrets.scan(docs_of(spark, rows)).collect()
    a = re.compile(secrets.ASSIGN.pattern, re.ASCII | re.IGNORECASE)
    want = defaultdict(list)
    for k, t in rows:
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        want[k].append(sorted(s))
    found = defaultdict(list)
    for g in got:
        found[g["doc_id"]].append([(x["start"], secrets.KINDS.index(x["kind"]), x["end"]) for x in g["spans"] if x["kind"] != "checked"])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_checksums_decide():
    body = "a1B2" * 7 + "zz"
    good = f"ghp_{body}{secrets.base62(zlib.crc32(body.encode()))}"
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    words = secrets.automaton()
    assert [x[1] for x in secrets.find(f"x {good} {bad}", words)] == [3]


# --- 8 lines ---


def line_truth(rows, step=1):
    """(forms, similar pairs, form -> group, dropped (doc_id, line)) by edit similarity of all pairs of forms alone, or of
    every step-th form and all longer ones."""
    occ = [(k, i, f) for k, t in sorted(rows, key=lambda x: x[0]) for i, x in enumerate((t or "").split("\n")) if (f := lines.normalise(x))]
    forms = sorted({o[2] for o in occ}, key=lambda f: (len(f), f))
    sizes, ones, twos = np.array([len(f) for f in forms]), np.zeros((len(forms), 64), np.int16), np.zeros((len(forms), 1024), np.int16)
    for i, f in enumerate(forms):
        c = np.frombuffer(f.encode("utf-32-le"), np.uint32).astype(np.int64)
        np.add.at(ones[i], c % 64, 1)
        np.add.at(twos[i], (c[1:] * 31 + c[:-1]) % 1024, 1)
    pairs = []
    for i, f in list(enumerate(forms))[::step]:
        to = np.searchsorted(sizes, sizes[i] / 0.8 + 1)
        limit = (0.2 * sizes[i + 1 : to] + 1e-9).astype(int)
        ok = np.flatnonzero((sizes[i + 1 : to] - sizes[i] <= limit) & (np.maximum(ones[i + 1 : to] - ones[i], 0).sum(1) <= limit))
        ok = ok[np.maximum(twos[ok + i + 1] - twos[i], 0).sum(1) <= 2 * limit[ok]]  # an edit takes two pairs of characters at most
        pairs += [(i, j) for j in (ok + i + 1).tolist() if lines.edit_distance(f, forms[j], n := int(0.2 * sizes[j] + 1e-9)) <= n]
    group, seen, gone = dict(zip(forms, union_find(len(forms), pairs))), set(), set()
    for k, i, f in occ:
        if group[f] in seen:
            gone.add((k, i))
        seen.add(group[f])
    return forms, [(forms[i], forms[j]) for i, j in pairs], group, gone


def test_lines_find_what_edit_similarity_alone_links(spark):
    """The truth knows neither bands nor hashes: recall of links over whole tables, of 0.95 or more."""
    for table, step in ((SF, 1), ("/root/testdata/sf0.01", 4)):
        rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{table}/documents.parquet").collect()]
        forms, pairs, _, gone = line_truth(rows, step)
        k = lambda f: lines.Words().lines(f)
        keys = {f: lines.line_keys(*(x := k(f))[:2], x[3], np.array([0]), lines.BANDS)[0] for f in {f for p in pairs for f in p}}
        met = sum(bool((keys[a] == keys[b]).any() and lines.similar_pairs(0.8)([a], [b])[0]) for a, b in pairs)
        assert len(pairs) > 40 and met >= 0.95 * len(pairs)
        if step == 1:
            dropped = sum(x["n_dropped"] for x in lines.dedup_lines(docs_of(spark, rows)).collect())
            assert 0.99 * len(gone) <= dropped <= len(gone)


def test_banded_lines_find_what_edit_similarity_links(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for i in range(150):  # one word in ten is another
        w = [word() for _ in range(20)]
        v = [word() if k in (3, 14) else x for k, x in enumerate(w)]
        rows += [(7000 + 2 * i, " ".join(w)), (7001 + 2 * i, " ".join(v))]
    rows += [(8000 + i, " ".join(["one", "stem", "of", "many", "lines", "that", "have", "their", "number", "at", "the", "end", str(i)])) for i in range(90)]
    out = lines.dedup_lines(docs_of(spark, rows), most=40).collect()
    got = {x["doc_id"]: x["text"] for x in out}
    forms, _, group, gone = line_truth(rows)
    left = Counter(f for t in got.values() for x in (t or "").split("\n") if (f := lines.normalise(x)))
    stayed = sum(left[f] for f in forms) - len(set(group.values()))
    assert len(gone) > 200 and 0 <= stayed <= 0.06 * len(gone)  # two words of twenty: at 0.65 of the pairs in common, 0.96 meet
    assert sum(x["n_dropped"] for x in out) == len(gone) - stayed
    assert [k for k in range(8000, 8090) if got[k]] == [8000]


def test_texts_are_fetched_by_a_bitmap_or_by_a_join(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = lines.occurrences(docs)
    wanted = common.cut(found.where("pmod(hash(node), 7) = 0").select("row", "again", "line").distinct())
    a, b = (lines.forms_at(docs, wanted, most) for most in (lines.FETCHED, 0))
    assert a.count() < b.count() / 2
    a, b = (sorted(map(tuple, x.join(wanted, ["row", "again", "line"]).select("row", "line", "form").collect())) for x in (a, b))
    assert a == b and len(a) >= wanted.count()


def test_bounds_by_words_hold():
    r = random.Random(10)
    for _ in range(2000):
        v, w = ([r.choice(["a", "bb", "ccc", "dd", "e", "ffff", "g"]) for _ in range(r.randint(1, 9))] for _ in range(2))
        a, b = " ".join(v), " ".join(w)
        assert lines.by_words(v, w) >= lines.edit_distance(a, b, 99) and lines.by_words(v, v) == 0


def test_all_words_of_a_line_tell_it(spark):
    r = random.Random(9)
    rows, long = [], ["mountains", "rivers"]
    for i in range(60):  # of two long words one changes, all short ones stay
        w = ["".join(r.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(30)]
        rows += [(2 * i, " ".join([*w, *long])), (2 * i + 1, " ".join([*w, "mountains", "valley"]))]
    out = {x["doc_id"]: x["n_dropped"] for x in lines.dedup_lines(docs_of(spark, rows)).collect()}
    assert out == {k: k % 2 for k in range(120)}


def test_short_lines_and_those_without_spaces_take_part(spark):
    long = "".join(chr(0x4E00 + 7 * i % 3000) for i in range(200))
    text = f"A Heading\n\n{long}\n---\nx\n  \n日本\n***"
    rows = [(1, text), (2, text), (3, f"a heading!\n{long[:50]}好{long[51:]}\n--- \nother\n\n===")]
    out = {x["doc_id"]: x["text"] for x in lines.dedup_lines(docs_of(spark, rows)).collect()}
    assert out == {1: text, 2: "\n  ", 3: "other\n\n==="}
    assert {x["doc_id"]: x["n_dropped"] for x in queries.op8_fuzzy_lines(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = Counter(f for x in corpus_pipeline.without_repeated_lines(spark, docs, SF).collect() for t in x["text"].split("\n") if (f := lines.normalise(t)))
    assert max(seen.values()) == 1


def test_lines_take_awkward_rows(spark):
    d = docs_of(spark, awkward())
    out = lines.dedup_lines(d).collect()
    assert len(out) == len(awkward()) and out[0].__fields__ == [*d.columns, "n_dropped"]
    assert [r["text"] for r in out if r["doc_id"] == 9] == ["same words in this line"] and [r["text"] for r in out if r["doc_id"] == 4] == ["one", "one"]
    assert sorted(len(r["text"]) > 0 for r in out if r["doc_id"] in (5, 6)) == [False, True]
    assert lines.dedup_lines(docs_of(spark, [])).count() == 0


def test_edit_distance_is_exact():
    def slow(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    r = random.Random(7)
    pairs, want = [], []
    for _ in range(800):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 18))) for _ in range(2))
        for limit in (0, 3, 30):
            assert lines.edit_distance(a, b, limit) == min(slow(a, b), limit + 1)
        longer = max(len(a), len(b))
        if a and b:
            pairs.append((a, b))
            want.append((slow(a, b), longer))
    wide = ["".join(r.choice("abcd") for _ in range(r.randint(1, 200))) for _ in range(60)]
    pairs += zip(wide[::2], wide[1::2])
    want += [(slow(a, b), max(len(a), len(b))) for a, b in zip(wide[::2], wide[1::2])]
    assert lines.distances(*map(list, zip(*pairs))).tolist() == [d for d, _ in want]
    shared = [(p := lines.Form(a).features, q := lines.Form(b).features) and len(p & q) >= lines.LEAST_SHARED * len(p | q) for a, b in pairs]
    same = [len(a.split(" ")) == len(b.split(" ")) and sum(max(len(x), len(y)) for x, y in zip(a.split(" "), b.split(" ")) if x != y) <= int(0.2 * n + 1e-9) for (a, b), (_, n) in zip(pairs, want)]
    assert lines.similar_pairs(0.8)(*map(list, zip(*pairs))) == [d <= int(0.2 * n + 1e-9) and (s or e) for (d, n), s, e in zip(want, shared, same)]


def test_scattered_letters_are_no_reason_to_pass_over_a_pair():
    """A letter in each of two words of ten or so: few pairs of words are left, but the lines are alike."""
    r = random.Random(8)
    xs, ys = [], []
    for k in range(400):
        w = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(12)]
        v = ["z" + x[1:] if i % 2 else x for i, x in enumerate(w)] if k % 2 else ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(12)]
        xs.append(" ".join(w))
        ys.append(" ".join(v))
    assert lines.similar_pairs(0.8)(xs, ys) == [k % 2 == 1 for k in range(400)]
    limits = [r.randrange(40) for _ in xs]
    assert lines.distances(xs, ys, limits).tolist() == [min(d, n + 1) for d, n in zip(lines.distances(xs, ys).tolist(), limits)]


# --- 9 search ---


def test_recall_order_and_awkward_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    x = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in v.collect()}
    hot = x[40].tolist()
    more = [(9000 + i, hot) for i in range(60)] + [(9100, None), (9120, [0.0] * 64), (9140, [float("nan")] * 64), (9160, [1.0]), (None, hot), (40, hot), (9180, [None] * 64)]
    got = defaultdict(list)
    for r in ann.nearest(v.unionByName(spark.createDataFrame(more, v.schema)), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x |= {9000 + i: x[40] for i in range(60)}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    assert set(got) == {i for i in x if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        s = m @ x[q]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:20]]
        hit += len(set(best.tolist()) & {f[1] for f in found})
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - float(x[f[1]] @ x[q])) < 1e-9 for f in found)
    assert hit / (20 * len(got)) > 0.95
    assert ann.nearest(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(v.where("vec_id < 5"), F.col("vec_id") == 0).count() == 4


def test_recall_where_blocks_exceed_what_is_reranked(spark):
    """Twenty thousand vectors, a fifth of them in one tight cluster: blocks of some 1,200 and 10,000."""
    r = np.random.default_rng(13)
    x = r.normal(size=(20_000, 32))
    x[:4000] = r.normal(size=32) + 0.15 * r.normal(size=(4000, 32))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    for block in (1250, 10_000):
        got = defaultdict(set)
        for q in ann.nearest(frame, F.col("vec_id") % 100 == 0, block=block).collect():
            got[q["query_id"]].add(q["vec_id"])
        hit = 0
        for q, found in got.items():
            s = x @ x[q]
            s[q] = -np.inf
            hit += len(set(np.argpartition(-s, 20)[:20].tolist()) & found)
        print("recall", block, hit / (20 * len(got)))
        assert len(got) == 200 and hit / (20 * len(got)) > 0.95


def test_each_length_is_searched_among_its_own(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 9)] + [(20 + i, [0.0, float(i), 2.0]) for i in range(3)] + [(40, [1.0] * 5)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for q in ann.nearest(d, F.col("vec_id") % 20 <= 1, k=3).orderBy("query_id", "rank").collect():
        got[q["query_id"]].append((q["vec_id"], q["score"]))
    assert got == {1: [(8, 9.0), (7, 8.0), (6, 7.0)], 20: [(21, 4.0), (22, 4.0)], 21: [(22, 6.0), (20, 4.0)]}
    third = 1 / 3
    (x,) = ann.nearest(spark.createDataFrame([(0, [third, 1.0]), (1, [third, third])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert x["score"] == third * third + third
    with pytest.raises(ValueError, match="lengths"):
        ann.nearest(spark.createDataFrame([(i, [1.0] * (i + 1)) for i in range(70)], "vec_id long, embedding array<double>"), F.lit(True))


# --- 10 BPE ---


def test_ids_equal_the_library_and_decode(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + awkward()
    rows += [(2000 + i, t) for i, t in enumerate(["a" * 5000, "ab" * 3000, "it's we'll \n\n  x", "ſK 😀é" * 50, " " * 300, "<|endoftext|>", "x" * 2047 + "y", "1234567 89"])]
    d = docs_of(spark, rows)
    got = bpe.encode(d, ranks, public_tokenizers.PATTERN, decoded=True)
    found = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in got.collect())
    want = Counter()
    for k, t in rows:
        ids = own.encode_ordinary(t or "")
        want[(k, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode())] += 1
    assert found == want
    back = Counter((r["doc_id"], r["text"]) for r in bpe.decode(got, ranks).collect())
    assert back == Counter((k, t or "") for k, t in rows)


# --- queries ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    clean = lambda df: Counter(tuple(None if x is None or x != x else int(x) if isinstance(x, float) else x for x in r) for r in df.reindex(sorted(df.columns), axis=1).astype(object).itertuples(index=False))
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE[name]).df()
    want = want.astype(object).where(want.notna(), None)
    assert clean(got) == clean(want)


def test_secret_digests(spark):
    rows = {r["doc_id"]: r for r in queries.op7_secrets(spark, SF).collect()}
    for k, r in rows.items():
        base = ",".join(s for s in r["spans"].split(",") if s and not s.startswith("checked"))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len([s for s in base.split(",") if s])


def test_word_hashes_follow_the_normal_form():
    texts = ["The cat, the CAT.\n\nÉté -- été!\tx_1\r\nfoo-bar \x0b foobar", "", "\n", "... !!!", "a" * 70_000 + " b"]
    seen, w = {}, lines.Words()
    for text in texts:
        hashes, sizes, chars, _ = w.lines(text)
        assert chars.tolist() == [len(lines.normalise(x)) for x in text.split("\n")]
        forms = [lines.normalise(x).split(" ") if lines.normalise(x) else [] for x in text.split("\n")]
        assert [len(f) for f in forms] == sizes.tolist()
        for word, h in zip([x for f in forms for x in f], hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_latin_text_is_plain_as_it_is():
    every = "".join(chr(c) for c in range(32, 0x3000) if not 0xD800 <= c < 0xE000)
    for i in range(0, len(every), 7):
        t = "Äb " + every[i : i + 7]
        assert lines.lowered(t).tobytes().decode() == lines.plain(t.lower())


def test_word_hashes_pass_over_unicode_punctuation_and_space():
    same = ["dont say hello to me¿ ever", "don’t say “hello” to\u00a0me — ever…", "¿don't say «hello»\u2003to me –\u202fever?", "don't\u3000say 「hello」 to me。 e\u00adver\u2028"]
    assert {lines.normalise(x) for x in same} == {"dont say hello to me ever"}
    hashes, sizes, _, _ = lines.Words().lines("\n".join([*same, "İ ſ — ñandú हिन्दी"]))
    assert sizes.tolist() == [6, 6, 6, 6, 4] and len(set(map(tuple, hashes[:24].reshape(4, 6).tolist()))) == 1
    assert lines.normalise("हिन्दी — ñandú") == "हिन्दी ñandú"
