"""Collocations, spelling variants and vector groups against brute force, and awkward rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.llm import collocations, queries, spelling, vectors

from .test_operators import SF, awkward, docs_of, union_find

# --- collocations ---


def brute_collocations(rows, most=2000, least=10, covered=50):
    """rows: (lang, text). Counts of whole phrases by their words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, w), a in found.items():
        longer = [b for (g, v), b in found.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))] if len(w) == 2 else []
        if any(100 * b >= covered * a for b in longer):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:most]))


PHRASES = [
    *[("en", "Strong tea, strong TEA\tand strong tea. Not\nstrong; tea")] * 6, *[("en", "in spite of it all in spite of")] * 12, *[(None, "x y x y x y x")] * 5, *[("und", "x y")] * 3,
    *[("fr", "été été été été")] * 5, *[("de", "Ä b ä b")] * 11, ("en", None), (None, ""), ("en", "a" * 3000 + " b " + "word " * 20_000), *[("xx", "p q r")] * 12, *[("xx", "p q s")] * 12,
]


def phrase_docs(spark, rows):
    return spark.createDataFrame([(lang, text, "x", "x", 1.5) for lang, text in rows], "lang string, text string, a string, key string, rank double")


@pytest.mark.parametrize("bits", [56, 9])
def test_collocations_equal_brute_force(spark, bits):
    """With nine bits most fingerprints stand for several phrases, which are then counted by their texts."""
    got = sorted(map(tuple, collocations.collocations(phrase_docs(spark, PHRASES).repartition(3), bits=bits).collect()))
    assert got == brute_collocations(PHRASES)


def test_collocations_of_the_tables_with_few_bits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, queries.op11_collocations(spark, SF).collect()))
    assert len(want) > 100 and sorted(map(tuple, collocations.collocations(docs, bits=16).collect())) == want


def test_collocations_are_written_twice_where_fingerprints_tell_all(spark, monkeypatch):
    """Every file in the shared folder may start a process that for a moment counts as a copy of the executor."""
    done = []
    monkeypatch.setattr(collocations, "cut", lambda df, f=collocations.cut: done.append(df.columns) or f(df))
    docs = phrase_docs(spark, PHRASES)
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == brute_collocations(PHRASES) and len(done) == 2
    assert sorted(map(tuple, collocations.collocations(docs, bits=9).collect())) == brute_collocations(PHRASES) and len(done) == 5


def test_collocations_keep_so_many_and_take_empty_tables(spark):
    docs = phrase_docs(spark, PHRASES)
    assert sorted(map(tuple, collocations.collocations(docs, most=2).collect())) == brute_collocations(PHRASES, most=2)
    assert collocations.collocations(docs.where("false")).collect() == [] and collocations.collocations(docs.where("text is null")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    """The score's formula on counts whose products pass 64 bits, as in collocations()."""
    a, left, right = 3_000_000_019, 3_000_000_023, 7_000_000_001
    wide = "cast({} as decimal(15,0))".format
    got = spark.sql(f"select (cast(1000000 as decimal(7,0)) * ({wide(f'{a}L')} * {wide(f'{a}L')})) div ({wide(f'{left}L')} * {wide(f'{right}L')})").first()[0]
    assert got == 1_000_000 * a * a // (left * right)


def test_windows_of_words_meet_at_their_edges(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["one two three", "", None, "four, five six seven eight", "nine"] * 7)
    seeds = np.arange(35, dtype=np.uint64)
    words = collocations.Words(texts)

    def all_runs():
        return sorted((k, int(i), int(h)) for fp, _, at, k in collocations.Hasher(56).runs(words, seeds) for h, i in zip(fp, at))

    whole = all_runs()
    monkeypatch.setattr(collocations, "WINDOW", 9)
    assert all_runs() == whole and Counter(k for k, _, _ in whole) == {1: 63, 2: 35, 3: 21}


# --- spelling variants ---


def brute_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute_variants(rows):
    n = brute_words(rows)
    gaps = defaultdict(set)  # words by what is left of them without one letter
    for w in n:
        for i in range(len(w)):
            gaps[w[:i] + w[i + 1 :], len(w), i].add(w)
    near = defaultdict(set)
    for (rest, _, _), same in gaps.items():
        for w in same:
            near[w] |= same - {w}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


def test_variants_equal_brute_force_on_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op12_spelling_variants(spark, SF).collect()))
    assert len(got) > 1000 and got == brute_variants(rows)


WORDS = ["house", "houses", "hause", "haus", "ouse", "mouse", "aaaaa", "aaaaaa", "aaaaaaa", "ébène", "Ébène", "ebene", "abcdefghij", "bacdefghij", "abcdefghijk", "xbcdefghij", "abcdefghi", "long" * 400, "long" * 400 + "s"]


def test_variants_of_awkward_rows(spark):
    rows = [(i, w) for k, w in enumerate(WORDS) for i in range(3 + 5 * k)] + [(None, "house house2house-HOUSE"), (None, None), (7, ""), (7, "naïve NAÏVE naÏve ﬁlters œuvre")] + [(r[0], r[1]) for r in awkward()]
    got = sorted(map(tuple, spelling.variants(docs_of(spark, rows)).collect()))
    assert got == brute_variants(rows) and any(r[1] for r in got)
    assert spelling.variants(docs_of(spark, []).where("false")).collect() == []


@pytest.mark.parametrize("most, stretch", [(7, 4), (4096, 512)])
def test_full_keys_are_dealt_out(spark, most, stretch):
    """Words over two letters make keys of hundreds of words; in chunks of seven the sums are the same."""
    r = np.random.default_rng(5)
    words = sorted({"".join(r.choice(list("ab"), int(r.integers(5, 9)))) for _ in range(900)})
    table = spark.createDataFrame([(w, int(r.integers(3, 50))) for w in words], "word string, n long")
    n = dict(map(tuple, table.collect()))
    want = {}
    for w in words:
        near = {v for i in range(len(w) + 1) for c in "ab" for v in (w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :])} - {w}
        if near := near & n.keys():
            best = min(near, key=lambda x: (-n[x], x))
            want[w] = (len(near), n[best], best)
    got = {x["word"]: (x["n_near"], x["form_n"], x["form"]) for x in spelling.near(table, most, stretch).collect()}
    assert got == want


def test_roots_of_long_chains(spark):
    rows = [(f"w{i:03d}", f"w{i + 1:03d}" if i % 50 != 49 else None) for i in range(200)]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()))
    assert got == {f"w{i:03d}": f"w{i - i % 50 + 49:03d}" for i in range(200)}


# --- vector groups ---


def brute_groups(rows, least=0.98):
    """rows: (vec_id, embedding, label) -> sorted (vec_id, n_links, component_id, kept)."""

    def usable(v, label):
        return label is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    groups, pairs, links = defaultdict(list), [], Counter()
    for i, (_, v, label) in enumerate(rows):
        if usable(v, label):
            groups[label, len(v)].append(i)
    for of in groups.values():
        x = np.array([rows[i][1] for i in of], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        pairs += [(of[i], of[j]) for i, j in zip(a.tolist(), b.tolist())]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    root, members = union_find(len(rows), pairs), defaultdict(list)
    for i, r in enumerate(root):
        members[r].append(rows[i][0])
    key = lambda r: tuple((x is not None, x) for x in r)
    out = []
    for i, (vec, _, _) in enumerate(rows):
        component = min((x for x in members[root[i]] if x is not None), default=None)
        out.append((vec, links[i], component, vec is not None and vec == component))
    return sorted(out, key=key)


def groups_of(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, node string, cells string, n int").repartition(5)
    return sorted(map(tuple, vectors.near_duplicates(table, **more).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def planted(n, dim, seed, spread=(0.02, 0.1, 0.2, 0.3)):
    """Random directions, a cluster of near copies, chains, and pairs on both sides of the limit, in three labels and none."""
    r = np.random.default_rng(seed)
    rows = [(i, r.standard_normal(dim), int(r.integers(0, 3)) if i % 11 else None) for i in range(n)]
    for i in range(n, 2 * n):
        of = rows[int(r.integers(0, n))] if i % 3 else rows[5]
        rows.append((i, of[1] + r.standard_normal(dim) * float(r.choice(spread)) * np.linalg.norm(of[1]) / math.sqrt(dim), of[2]))
    return [(i, np.float32(v).tolist(), label) for i, v, label in rows]


@pytest.mark.parametrize("dim, seed", [(64, 1), (16, 2), (3, 3)])
def test_groups_equal_brute_force(spark, dim, seed):
    rows = planted(400, dim, seed)
    got, want = groups_of(spark, rows), brute_groups(rows)
    assert sum(r[1] for r in want) > 1000
    assert sum(r[1] for r in got) >= 0.999 * sum(r[1] for r in want) and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g == w for g, w in zip(got, want)) >= 0.995 * len(want)


def test_full_cells_are_dealt_out(spark):
    rows = planted(200, 8, 4)
    assert groups_of(spark, rows, most=20) == groups_of(spark, rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (None, [2.0, 4.0], 1),
        (9, [1.0, 2.0], None), (10, [1.0, 2.0], 2), (11, [-1.0, -2.0], 1), (12, [1.0, 2.0, 0.0], 1), (13, [1e-30, 2e-30], 1), (14, [1e30, 2e30], 1), (None, [5.0, -1.0], 1), (None, None, None), (15, [-0.0, 1.0], 3), (16, [0.0, 1.0], 3),
        (17, [3.0], 4), (18, [5.0], 4), (19, [-5.0], 4), (13, [1.0, 0.0], 5),
    ]
    assert groups_of(spark, rows) == brute_groups(rows)
    assert groups_of(spark, []) == []
    assert groups_of(spark, rows[:1]) == [(1, 0, 1, True)]


def test_equal_vectors_are_one_node(spark):
    """A third of all rows hold one vector; each links with all the others."""
    rows = planted(100, 16, 6) + [(1000 + i, [1.0] * 16, 1) for i in range(100)] + [(2000, [1.0] * 15 + [1.01], 1)]
    got = {r[0]: r for r in groups_of(spark, rows)}
    assert got[1000] == (1000, 100, 1000, True) and got[1099] == (1099, 100, 1000, False) and got[2000] == (2000, 100, 1000, False)


def test_recall_on_many_vectors(spark):
    """More projections a table, for more vectors: pairs between cosines of 0.98 and 0.995 are found too."""
    p = vectors.plan(200_000)
    assert p.width >= 6 and p.tables > vectors.plan(1000).tables
    r = np.random.default_rng(9)
    x = r.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    angle = np.arccos(r.uniform(0.98, 0.995, 3000))
    y = r.standard_normal((3000, 64))
    y -= (y * x).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    y = np.cos(angle)[:, None] * x + np.sin(angle)[:, None] * y
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.float32(np.concatenate([x, y])))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    linked = vectors.near_duplicates(table).where("n_links > 0").count()
    assert linked >= 0.998 * 6000


def test_links_of_the_tables(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.op13_vector_groups(spark, SF).collect()))
    assert got == brute_groups(rows)


# --- mended in this round ---


def test_salvage_of_version_lines_is_linear():
    import time

    from siftmark.llm import warc

    def took(n):
        data = b"WARC/1.1\r\n" * n + b"WARC/1.1\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
        began = time.perf_counter()
        found = list(warc.salvage(data))
        assert [type(x).__name__ for x in found] == ["Gap", "Record"] and found[1].block == b"ok"
        return time.perf_counter() - began

    took(1000)
    assert took(400_000) < 8 * max(took(100_000), 0.05)


def test_archives_are_rolled_by_classes_of_size(spark, tmp_path):
    from siftmark.llm import warc

    sizes = [10] * 30 + [3000] * 12 + [20_000] * 6 + [150_000]
    pages = spark.createDataFrame([(i, f"http://x/{i}", "y" * n + str(i)) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), compressed=False, file_bytes=64_000, large=2048)
    files = sorted(p.stat().st_size for p in (tmp_path / "w").glob("part-*"))
    assert len(files) < 12 and sum(f > 64_000 for f in files) == 1 and files[-1] > 150_000
    found = warc.records(warc.read_archives(spark, str(tmp_path / "w")), whole=True)
    assert sorted(r["payload_bytes"] for r in found.collect()) == sorted(n + len(str(i)) for i, n in enumerate(sizes))


def test_small_sources_keep_their_quota(spark):
    from siftmark.llm import mixing

    sizes = spark.createDataFrame([("vbig", 10, 10**13), ("vsmall", 3, 120), ("vtiny", 1, 1)], "key string, n_docs long, n_tokens long")
    got = {r["key"]: (r["quota"], r["epochs"]) for r in mixing.weights(sizes, max_repeats=1.0).collect()}
    assert got["vsmall"] == (120, 1) and got["vtiny"] == (1, 1) and abs(got["vbig"][0] - 10**13) <= 1


def test_long_pieces_merge_as_the_library_does():
    import random

    import public_tokenizers
    import tiktoken

    from siftmark.llm import bpe

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    vocabulary, library = bpe.Vocabulary(ranks), tiktoken.Encoding("all", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    for n in (2048, 5000, 40_000):
        for letters in ("abcde theorting", "a", "é€x"):
            x = "".join(r.choice(letters) for _ in range(n))
            got = vocabulary.merge_long(vocabulary.of_byte[np.frombuffer(x.encode(), np.uint8)])
            assert got.tolist() == library.encode_ordinary(x)


def test_lines_that_share_a_passage_are_compared_side_by_side(monkeypatch):
    import random

    from siftmark.llm import lines

    r = random.Random(88)
    w = lambda n: "".join(r.choice("abcdefgh ß") for _ in range(n))
    for _ in range(200):
        x = w(r.randint(1, 90))
        ys = [*(w(r.randint(0, 20)) + x[k:] for k in range(0, len(x), 9)), *(w(r.randint(0, 60)) for _ in range(4)), x]
        limits = [r.randint(0, 40) for _ in ys]
        want = [lines.edit_distance(x, y, k) <= k for y, k in zip(ys, limits)]
        assert lines.within(x, ys, limits) == want
        monkeypatch.setattr(lines, "SIDE_BY_SIDE", 100)
        assert lines.within(x, ys, limits) == want
        monkeypatch.undo()
    passage = w(300)
    forms = [f"{w(150)} {passage}" for _ in range(60)]
    alone = []
    monkeypatch.setattr(lines, "edit_distance", lambda *a, f=lines.edit_distance: alone.append(a) or f(*a))
    monkeypatch.setattr(lines, "by_words", lambda *a, f=lines.by_words: alone.append(a) or f(*a))
    assert not any(lines.similar_pairs(0.8)(forms[:1] * 59, forms[1:])) and not alone


def test_candidates_of_packed_keys_are_those_of_all_keys(spark):
    """Every two ids that share a key meet, once, as a pair or in a tile; copies and very common keys as others; and a task that may hold few
    keys lets the long runs go in chunks before the bucket has ended."""
    import random
    from itertools import combinations

    import pyarrow as pa

    from siftmark.llm import minhash

    r = random.Random(3)
    rows = [(i % 900, k) for i in range(1000) for k in {r.randint(1, 400), r.randint(401, 5000), 9999 if i % 2 else 9998}]
    of = {}
    for i, k in rows:
        of.setdefault(k, set()).add(i)
    want = {p for v in of.values() for p in combinations(sorted(v), 2)}
    entries = lambda b: (b.column(1).to_numpy(), b.column(0).to_numpy())
    pairs, tiled = minhash.candidates(spark.createDataFrame(rows, "id long, key long"), entries, len(rows), 64, 0.8)
    got = [(x["a"], x["b"]) for x in pairs.collect()]
    tiles = {}
    for x in tiled.collect():
        tiles.setdefault((x["key"], x["i"], x["j"]), []).append(x["id"])
    assert len(got) == len(set(got)) and max(map(len, tiles.values())) <= 128
    assert {*got, *(p for v in tiles.values() for p in combinations(sorted(set(v)), 2))} == want

    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([k for _, k in rows])], names=["id", "key"])
    dealt = [b.slice(k, 1) for part in range(0, len(rows), 100) for b in minhash._dealt(entries, 1)(iter([batch.slice(part, 100)])) for k in range(b.num_rows)]
    found, chunked = set(), {}
    for x in minhash._found(64, 0.8, 200)(iter(dealt)):
        for k, c, a, b in zip(*(v.to_pylist() for v in x.columns)):
            found.add((a, b)) if c < 0 else chunked.setdefault(k, set()).add((c, a))
    assert len({c for c, _ in chunked[9999]}) > 1
    assert found | {p for v in chunked.values() for p in combinations(sorted({a for _, a in v}), 2)} == want


def test_pairs_without_a_common_form_are_compared_side_by_side(monkeypatch):
    import random

    from siftmark.llm import lines

    r = random.Random(5)
    w = lambda n: "".join(r.choice("abcdefgh ß") for _ in range(n))
    for _ in range(100):
        monkeypatch.setattr(lines, "SIDE_BY_SIDE", r.choice([50, 500, 65_536]))
        xs = [w(r.randint(1, 120)) for _ in range(r.randint(1, 40))]
        ys = [x[r.randint(0, 9) : r.randint(9, 120)] + w(r.randint(1, 20)) if r.random() < 0.8 else w(r.randint(1, 150)) for x in xs]
        limits = [r.randint(0, 45) for _ in xs]
        assert lines.beside(xs, ys, limits) == [lines.edit_distance(x, y, k) <= k for x, y, k in zip(xs, ys, limits)]


def test_pairs_that_are_connected_already_are_not_compared(spark):
    """Of sixteen like members fifteen of 120 pairs are compared; the groups are those of all pairs, also where ids have two nodes."""
    import random
    from itertools import combinations

    import pandas as pd
    import pyarrow as pa

    from siftmark.llm import minhash

    names = ["first", "id", "mates", "node", "body"]
    rows = pa.table([[0] * 16, list(range(16)), [list(range(k)) for k in range(16)], list(range(16)), ["x"] * 16], names=names)
    asked = []
    linked = lambda xs, ys: asked.extend(zip(xs, ys)) or [x[0] == y[0] for x, y in zip(xs, ys)]
    edges = [b.num_rows for b in minhash._verify_pairs(linked)(iter(rows.to_batches()))]
    assert sum(edges) == len(asked) == 15

    r = random.Random(9)
    content = [(i % 190, i, r.choice("abc") + str(i)) for i in range(200)]
    pairs = list({tuple(sorted(p)) for _ in range(60) for p in combinations(r.sample(range(190), r.randint(2, 9)), 2)})
    nodes = {}
    for i, x, body in content:
        nodes.setdefault(i, []).append((x, body))
    groups = lambda edges: {frozenset(v) for v in pd.Series(range(200)).groupby(union_find(200, edges)).agg(list)}
    got = minhash.verified(
        spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([], "key long, i int, j int, id long"),
        spark.createDataFrame(content, "id long, node long, body string"), lambda xs, ys: [x[0] == y[0] for x, y in zip(xs, ys)], "long",
    ).collect()
    want = groups([(x, y) for a, b in pairs for x, p in nodes[a] for y, q in nodes[b] if p[0] == q[0]])
    assert groups([(x["a"], x["b"]) for x in got]) == want and 3 < len(want) < 150
