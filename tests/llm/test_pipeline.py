"""The pipeline's stages, each against a brute-force version or its operator's own tests, on its own input."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from siftmark.llm import bpe, lines, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        before, at = at, spark.read.parquet(path)
        kept[name] = (before, at)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == columns
    before, after = kept["quality classifier"]
    ids = {r["doc_id"] for r in quality.resample(before, spark.read.parquet(f"{SF}/labels.parquet"))[0].collect()}
    assert {r["doc_id"] for r in after.collect()} == ids
    before, after = kept["line dedup"]
    seen = Counter(lines.normalise(x) for r in after.collect() for x in r["text"].split("\n"))
    assert all(n == 1 for form, n in seen.items() if len(form.split()) >= 5)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = kept["SimHash near-dedup"]
    fp = [r["fp"] & (2**64 - 1) for r in simhash.fingerprints(after, 3).collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fp) for b in fp[:i])
    all_fp = [r["fp"] & (2**64 - 1) for r in simhash.fingerprints(before, 3).collect()]
    assert all(min((a ^ b).bit_count() for b in fp) <= 9 for a in all_fp)
    before, after = kept["mixing sources to target weights"]
    texts = {(r["doc_id"], r["text"]) for r in before.collect()}
    assert all((r["doc_id"], r["text"]) in texts for r in after.collect())
    before, after = kept["byte-level BPE"]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((r["doc_id"], np.array(own.encode_ordinary(r["text"]), "<u4").tobytes()) for r in before.collect())
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in after.collect()) == want


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids"] and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_go_by_their_shingles(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    texts = {}
    for i in range(60):
        w = [word() for _ in range(120)]
        v = [word() if k % 60 == i % 60 else x for k, x in enumerate(w)]  # two words of 120: 0.8 or a little more
        u = [word() if k % 12 == 0 else x for k, x in enumerate(w)]  # far less
        texts |= {3 * i: " ".join(w), 3 * i + 1: "\n".join([" ".join(v[k : k + 4]) for k in range(0, 120, 4)]), 3 * i + 2: " ".join(u)}
    base = [word() for _ in range(300)]
    texts |= {1000 + i: " ".join([*base, str(i)]) for i in range(50)}
    texts |= {2000: "", 2001: "two words", 2002: "Two  words"}
    sets = {k: set(simhash.shingle_hashes(t, 5)) for k, t in texts.items()}
    gone = {b for b in sets for a in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sets[a]}
    docs = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, source string")
    kept = {x["doc_id"] for x in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()}
    assert len(gone) > 100 and kept == set(texts) - gone
    assert simhash.drop_similar(docs.where("false")).count() == 0
    assert {x["doc_id"] for x in simhash.drop_similar(docs, most=8).collect()} == kept


def test_near_copies_go_by_their_fingerprints(spark):
    """Two texts whose fingerprints differ in three bits, but whose five-word shingles are less than 0.8 alike."""
    r = random.Random(9)
    while True:
        w = [f"w{r.randrange(5000)}" for _ in range(400)]
        v = [f"x{r.randrange(5000)}" if k % 40 == 7 else x for k, x in enumerate(w)]
        a, b = " ".join(w), " ".join(v)
        p, q = (set(simhash.shingle_hashes(t, 5)) for t in (a, b))
        x, y = (int(simhash.majority(np.array(simhash.shingle_hashes(t, 3), np.uint64), np.array([0]))[0]) for t in (a, b))
        if (x ^ y).bit_count() <= 3 and len(p & q) < 0.8 * len(p | q):
            break
    docs = spark.createDataFrame([(1, a, "s"), (2, b, "s"), (3, "another text altogether", "s"), (None, b, "s")], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()) == [0, 1, 3]
