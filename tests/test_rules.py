"""Small fixtures for rules and operators whose every branch should be met: probes, patterns, catalogues, ranks, prefixes."""

import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from siftmark.functions import formats, text
from siftmark.operators import catalogue as ca
from siftmark.operators import contract as ct
from siftmark.operators import graph as gr
from siftmark.operators import probes as pr
from siftmark.operators import statistics as st
from siftmark.operators import twins as tw

AUDIO = {"tipo": "audio", "codec": "aac", "canales": 2, "sample_rate": 44100, "dur": 10.0, "bitrate_bps": 128000.0}
VIDEO = {"tipo": "video", "codec": "h264", "ancho": 640, "alto": 360, "dur": 10.0}
SUBS = {"tipo": "subtitulo"}
AV = {"categoria": "av", "dur": 10.0, "bitrate_bps": 1e6, "pistas": [VIDEO, AUDIO]}
IMAGE = {"categoria": "imagen", "ancho": 800, "alto": 600, "bits": 8}
PDF = {"categoria": "pdf", "paginas": 2, "ancho_pt": 400.0}


def change(base, **more):
    return {**base, **more}


CASES = [
    ("nothing to say", AV, AV, {"destino": "mp4"}, set()),
    ("no input", AV, None, {"destino": "mp4"}, {("V3-sin", "informativo")}),
    ("audio lost, subtitles added", change(AV, pistas=[VIDEO, SUBS]), AV, {"destino": "mkv"}, {("V3", "fallo"), ("V4", "aviso")}),
    ("a picture holds no sound", change(AV, pistas=[VIDEO]), AV, {"destino": "gif"}, set()),
    ("sound alone, by its track", change(AV, dur=99.0, pistas=[AUDIO]), AV, {"destino": "mp3", "solo_audio": True}, set()),
    ("sound alone, another length", change(AV, dur=10.0, pistas=[change(AUDIO, dur=12.0)]), AV, {"destino": "mp3", "solo_audio": True}, {("A1/V1", "fallo")}),
    ("video alone", change(AV, pistas=[VIDEO]), AV, {"destino": "mp4", "solo_video": True}, set()),
    ("asked-for tracks", change(AV, pistas=[VIDEO]), AV, {"destino": "mp4", "flujos": {"video": 1, "audio": 0, "subtitulo": 0}}, set()),
    ("empty container", change(AV, pistas=[], dur=None, bitrate_bps=0.0), None, {"flujos": {"video": 0, "audio": 0, "subtitulo": 0}}, {("G4-duration", "fallo"), ("G4-tracks", "fallo"), ("G4-rate", "aviso")}),
    ("odd tracks", change(AV, pistas=[change(VIDEO, ancho=None), change(AUDIO, canales=None, sample_rate=4000)]), None, {"flujos": {"video": 1, "audio": 1, "subtitulo": 0}}, {("V7-size", "fallo"), ("A2-none", "aviso"), ("A3-odd", "aviso")}),
    ("48 kHz of Opus", change(AV, pistas=[VIDEO, change(AUDIO, codec="libopus", sample_rate=48000)]), AV, {}, {("A3", "informativo")}),
    ("other rate and channels", change(AV, pistas=[VIDEO, change(AUDIO, sample_rate=22050, canales=1)]), AV, {}, {("A3", "fallo"), ("A2", "fallo")}),
    ("asked for both", change(AV, pistas=[VIDEO, change(AUDIO, sample_rate=22050, canales=1)]), AV, {"sample_rate": 22050, "canales": 1}, set()),
    ("more bits, the same sound", change(AV, pistas=[change(AUDIO, codec="flac", bits=24)]), change(AV, pistas=[change(AUDIO, codec="flac", bits=16)]), {}, {("A6", "aviso")}),
    ("rates", change(AV, bitrate_bps=3e5, pistas=[VIDEO, change(AUDIO, bitrate_bps=1e5)]), AV, {"bitrate_video_bps": 1e6, "bitrate_bps": 128000.0}, {("V10", "fallo"), ("A-rate", "aviso")}),
    ("sound explains the excess", change(AV, bitrate_bps=3e6), AV, {"bitrate_video_bps": 1e6}, {("V10", "informativo")}),
    ("resized", change(IMAGE, ancho=400), IMAGE, {}, {("I1/V7", "fallo"), ("I1-aspect", "aviso")}),
    ("not the size asked for", change(IMAGE, ancho=400, alto=300), IMAGE, {"ancho": 401, "alto": 300}, {("I1", "fallo")}),
    ("the size asked for", change(IMAGE, ancho=400, alto=300), IMAGE, {"ancho": 400}, set()),
    ("tiny, odd depth", change(IMAGE, ancho=1, alto=1, bits=7), None, {}, {("G4-size", "aviso"), ("G4-depth", "aviso")}),
    ("no size", change(IMAGE, ancho=None), None, {}, {("G4-size", "fallo")}),
    ("depth beyond the target", IMAGE, change(IMAGE, bits=16), {"destino": "jpg"}, {("I5", "informativo")}),
    ("depth lost", IMAGE, change(IMAGE, bits=16), {"destino": "png"}, {("I5", "fallo")}),
    ("depth asked for", IMAGE, change(IMAGE, bits=16), {"destino": "png", "bits": 8}, set()),
    ("alpha lost", IMAGE, change(IMAGE, alfa=True, alfa_min=10), {"destino": "png"}, {("I2", "fallo")}),
    ("alpha that the target can't hold", IMAGE, change(IMAGE, alfa=True, alfa_min=10), {"destino": "jpg"}, {("I2", "informativo")}),
    ("alpha of one value", IMAGE, change(IMAGE, alfa=True, alfa_min=255), {"destino": "png"}, set()),
    ("alpha unknown", IMAGE, change(IMAGE, alfa=True), {"destino": "png"}, {("I2", "informativo")}),
    ("pixels of a page", change(IMAGE, ancho=800, ppp=140.0), PDF, {"dpi": 150}, {("P4-dpi", "fallo"), ("P4-px", "fallo")}),
    ("pixels of a page, right", change(IMAGE, ancho=833, alto=600, ppp=150.4), PDF, {"dpi": 150}, set()),
    ("page box", change(PDF, ancho_pt=390.0), IMAGE, {"dpi": 150}, {("P7-box", "fallo")}),
    ("page box, right", change(PDF, ancho_pt=385.0), IMAGE, {"dpi": 150}, set()),
    ("a pixel a point", change(PDF, ancho_pt=1200.0), change(IMAGE, ancho=1200), {}, {("P7", "aviso")}),
    ("a pixel a point, small", change(PDF, ancho_pt=800.0), IMAGE, {}, set()),
    ("pages", change(PDF, paginas=3), PDF, {}, {("P1", "fallo")}),
    ("pages that can't be counted", change(PDF, paginas=None, comprimido=True), PDF, {}, {("P1-pages", "aviso")}),
    ("no pages", change(PDF, paginas=0), PDF, {}, {("P1-pages", "fallo")}),
    ("nothing known", None, None, None, set()),
]


def test_every_rule_of_probes_is_met_and_not_met(spark):
    rows = [(name, *[json.dumps(x) if x is not None else None for x in (e, s, p)]) for name, s, e, p, _ in CASES]
    df = spark.createDataFrame(rows, "name string, e string, s string, p string")
    parsed = df.select("name", F.from_json("e", pr.PROBE).alias("entrada"), F.from_json("s", pr.PROBE).alias("salida"), F.from_json("p", pr.ASKED).alias("pedido"))
    parsed = pr.prepared(parsed)
    got = {name: set() for name, *_ in CASES}
    for r in ct.findings(parsed, ["name"], pr.media_rules()).collect():
        got[r["name"]].add((r["rule"], r["severity"]))
    assert got == {name: want for name, *_, want in CASES}
    said = {rule for *_, want in CASES for rule, _ in want}
    assert {r.name for r in pr.media_rules()} - said == {"V7"}
    worst = {r["name"]: r["verdict"] for r in ct.verdicts(parsed, pr.media_rules(), ["name"], F.col("entrada").isNotNull()).collect()}
    assert worst["resized"] == "fallo" and worst["nothing to say"] == "ok" and worst["no input"] == "ok_parcial" and worst["a pixel a point"] == "aviso"


def test_printf_patterns(spark):
    names = ["f001.png", "f2.png", "f10.png", "f12.png", "f.png", "xf1.png", "f1.pngx", "a(1).[x]7+.png", "out.mpd", "out_1.m4s", "log.txt"]
    said = ["f%03d.png", "f%d.png", "a(1).[x]%i+.png", "out.mpd", "100%.txt"]
    both = spark.createDataFrame(list(itertools.product(names, said)), "n string, d string")
    got = {(r["n"], r["d"]) for r in both.where(ct.is_declared(F.col("n"), F.col("d"))).collect()}
    assert got == {(n, d) for d in said[:2] for n in ("f001.png", "f2.png", "f10.png", "f12.png")} | {("a(1).[x]7+.png", said[2]), ("out.mpd", "out.mpd")}
    beside = {r["n"] for r in both.where((F.col("d") == "out.mpd") & ct.is_satellite(F.col("n"), F.col("d"))).collect()}
    assert beside == {n for n in names if n.endswith(("png", "m4s", "mpd"))}
    listing = spark.createDataFrame([(k, n) for k in (1, 2) for n in names], "job int, n string")
    declared = spark.createDataFrame([(1, "f%d.png"), (1, "none%d.x"), (2, "a(1).[x]%u+.png"), (2, "out.mpd")], "job int, p string")
    found = {(r["job"], r["p"]): tuple(r)[2:] for r in ct.numbered_outputs(listing, declared, ["job"], "n", "p").collect()}
    assert found == {(1, "f%d.png"): (4, 1, 12, 2), (1, "none%d.x"): (0, None, None, None), (2, "a(1).[x]%u+.png"): (1, 7, 7, 0)}
    assert ct.numbered_outputs(listing, declared.where("false"), ["job"], "n", "p").collect() == []


def test_facts_of_data_files(spark):
    rows = [(1, b'{"a": 1}', "json"), (2, b'{"a": 1', "json"), (3, b"a,b\n1,2\n\n3,4\n", "csv"), (4, b"a,b\r\n1,2,3\r\n", "csv"), (5, b"\xef\xbb\xbfa,b\n1,2", "csv"), (6, b"a\xff", "txt"), (7, "x�".encode(), "txt"), (8, b"", "csv"), (9, None, "csv"), (10, b"\xef\xbb\xbf[1]", "json")]
    got = {r["i"]: r["f"] for r in spark.createDataFrame(rows, "i int, c binary, k string").select("i", text.data_facts(F.col("c"), F.col("k")).alias("f")).collect()}
    assert [got[i]["json_valido"] for i in (1, 2, 3, 10)] == [True, False, None, True]
    assert [got[i]["anchos"] for i in (3, 4, 5, 8)] == [[2], [2, 3], [2], []]
    assert {i for i in got if got[i]["bom"]} == {5, 10} and {i for i in got if got[i]["utf8_valido"] is False} == {6} and {i for i in got if got[i]["reemplazo"]} == {7}


def test_guarded_probes(spark):
    kind = "motor string, build string, interprete string, huella map<string,string>"
    probes = [("ok", "1", "py3", {"a": "x", "old": "1"}), ("build", "2", "py3", {"a": "x"}), ("interp", "1", "py2", {}), ("parts", "1", "py3", {"a": "y", "b": "z", "c": "w"}), ("bare", None, None, None), ("gone", "1", "py3", {}), ("unknown now", "1", "py3", {"a": "x"})]
    there = [(m, "1", "py3" if m != "unknown now" else None, {"a": "x", "b": "q", "c": "w", "new": "n"}) for m in ("ok", "build", "interp", "parts", "bare", "unknown now", "other")]
    got = {r["motor"]: tuple(r)[1:] for r in gr.guarded_probes(spark.createDataFrame(probes, kind), spark.createDataFrame(there, kind)).collect()}
    assert got == {
        "ok": ("valida", None, "", True), "build": ("build_distinto", None, None, False), "interp": ("interprete_distinto", None, None, False), "parts": ("caducada", "a,b", None, False), "bare": ("valida", None, "sin_interprete,sin_huella", True),
        "gone": ("sin_instalar", None, None, False), "unknown now": ("interprete_distinto", None, None, False),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_changes_equal_all_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(f"f{k}", float(r.randrange(n)), float(r.randrange(n))) for k, n in enumerate((2, 5, 40, 1000)) for _ in range(150)] + [("one", 1.0, 1.0), ("none", None, 1.0)]
    got = {x["f"]: tuple(x)[1:] for x in st.rank_changes(spark.createDataFrame(rows, "f string, a double, b double"), "f", "a", "b").collect()}
    want = {}
    for f in {x[0] for x in rows} - {"none"}:
        cells = [x[1:] for x in rows if x[0] == f]
        pairs = list(itertools.combinations(cells, 2))
        d = [((x[0] - y[0]), (x[1] - y[1])) for x, y in pairs]
        best = [{i for i, c in enumerate(cells) if c[k] == min(c[k] for c in cells)} for k in (0, 1)]
        want[f] = (len(pairs), sum(a * b < 0 for a, b in d), sum(a == 0 != b for a, b in d), sum(a != 0 == b for a, b in d), best[0] != best[1])
    assert got == want


def test_prefixes_of_heads(spark):
    rows = [("a", "m1", "RIFFxWAVE"), ("a", "m1", "RIFFyWAVE"), ("a", "m2", "RIFFxWAVE"), ("a", "m2", "RIFFxWAVE"), ("b", "m1", "RIFFzzz"), ("b", "m1", "RIFFyyy"), ("c", "m1", "qqq"), ("c", "m1", "rrr"), ("d", "m9", ""), ("e", "m1", "RIFFq"), ("e", "m1", "RIFF"), ("f", "m1", "RIFFxWA"), ("f", "m1", "RIFFxWA")]
    best = st.best_evidence(spark.createDataFrame(rows, "k string, m string, h string"), "k", "m", "h")
    assert {tuple(r) for r in best.collect()} == {("a", "m2", 2, "RIFFxWAVE"), ("b", "m1", 2, "RIFF"), ("c", "m1", 2, ""), ("d", "m9", 1, ""), ("e", "m1", 2, "RIFF"), ("f", "m1", 2, "RIFFxWA")}
    got = {r["prefix"]: (r["kinds"], r["under"]) for r in st.shared_prefixes(best, "k").collect()}
    assert got == {"RIFFxWAVE": (["a"], "RIFFxWA"), "RIFF": (["b", "e"], None), "RIFFxWA": (["f"], "RIFF")}


TOOLS = [
    (1, "read_file_text", "Reads a\nfile. Args: path", {"properties": {"p": {"type": "string", "description": "x"}}, "required": ["p"]}),
    (2, "read_file_bytes", "reads  a file.", {"properties": {"q": {"type": "string"}}, "required": ["q"]}),
    (3, "write-file", "See above", {"properties": {"o": {"type": "object"}, "l": {"type": "array", "items": {"type": "object"}}, "s": {"type": "array", "items": {"type": "string"}}, "d": {"type": "object", "properties": {"x": {}}, "description": "y"}}}),
    (4, "none", None, {}),
    (5, "Read.File.Image", "TODO, same as below", {"properties": {}, "required": []}),
    (6, "broken", "", None),
]


def test_catalogues(spark):
    df = spark.createDataFrame([(i, n, d, json.dumps(s) if s is not None else "{cut") for i, n, d, s in TOOLS], "id int, name string, description string, schema string")
    params = ca.parameters(df, "id", "schema")
    got = {(r["id"], r["param"]): tuple(r)[2:] for r in params.collect()}
    assert got == {(1, "p"): ("string", True, True, False), (2, "q"): ("string", True, False, False), (3, "o"): ("object", False, False, True), (3, "l"): ("array", False, False, True), (3, "s"): ("array", False, False, False), (3, "d"): ("object", False, True, False)}
    assert {tuple(r) for r in ca.groups(ca.shapes(params, "id"), ["shape"], "id").collect()} == {("string!", 2, 1)}
    assert {tuple(r) for r in ca.prefix_families(df, "id", "name").collect()} == {("read_file", 3, 1)}
    same = ca.groups(df.select("id", F.lower(ca.summary(F.col("description"))).alias("s")), ["s"], "id")
    assert {tuple(r) for r in same.collect()} == {("reads a file.", 2, 1), ("", 2, 4)}
    assert {r["id"]: r["marks"] for r in ca.referring(df, "id", "description").collect()} == {3: ["see ", "above"], 5: ["below", "todo", "same as"]}
    assert [tuple(r) for r in ca.schema_gaps(params.withColumn("c", F.lit(1)), ["c"]).collect()] == [(1, 6, 4, 2)]


def names(n, seed):
    r = random.Random(seed)
    words = ["read", "write", "file", "image", "text", "convert", "list", "x", "audio", "the", "ñandú"]
    out = ["_".join(r.choice(words) for _ in range(r.randrange(0, 5))) for _ in range(n)]
    return out + [x + r.choice("abc") for x in out[: n // 2]]


@pytest.mark.parametrize("least, block", [(0.70, 512), (0.85, 9)])
def test_string_twins_equal_all_pairs(spark, least, block):
    rows = list(enumerate([*names(120, 1), None, ""]))
    got = sorted(map(tuple, tw.string_twins(spark.createDataFrame(rows, "k int, t string"), "k", F.col("t"), least, block).collect()))
    one = {}
    for k, t in rows:
        one.setdefault(t or "", k)
    want = [(i, j, tw.ratio(a, b)) for (a, i), (b, j) in itertools.combinations(sorted(one.items(), key=lambda x: x[1]), 2) if tw.ratio(a, b) >= least]
    assert len(want) > 50 and got == sorted(want)


def test_twin_report_equals_all_pairs(spark):
    r = random.Random(4)
    rows = [(i, n, r.choice(["Reads a file", "Reads the file", "Writes text to a file", "Lists", ""]), r.sample(["a", "b", "c"], r.randrange(3))) for i, n in enumerate(names(40, 2))]
    got = tw.twin_report(spark.createDataFrame(rows, "k int, n string, d string, p array<string>"), "k", F.col("n"), F.col("d"), F.col("p")).collect()
    first = {t: min(x[0] for x in rows if t in x[1:3]) for x in rows for t in x[1:3]}

    def alike(a, b):  # texts in the order of their first rows, on which difflib may depend
        return tw.ratio(*sorted((a, b), key=first.get))

    pairs = [(x, y, alike(x[1], y[1]), alike(x[2], y[2])) for x, y in itertools.combinations(rows, 2)]
    d7 = {k for x, y, _, d in pairs if d >= 0.7 for k in (x[0], y[0])}
    both = {k for x, y, n, d in pairs if d >= 0.7 and n >= 0.7 for k in (x[0], y[0])}
    same = sum(set(x[3]) == set(y[3]) for x, y, *_ in pairs)
    want = (len(rows), sum(n >= 0.7 for *_, n, _ in pairs), sum(d >= 0.7 for *_, d in pairs), sum(d >= 0.85 for *_, d in pairs), same, sum(n >= 0.7 and d >= 0.7 for *_, n, d in pairs), round(len(d7) / len(rows), 6), round(len(both) / len(rows), 6))
    assert [tuple(x) for x in got] == [want]


def test_megapixels_of_the_largest_sides(spark):
    rows = [(i, b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + w + h) for i, (w, h) in enumerate([(b"\xff" * 4, b"\xff" * 4), (b"\0\0\x02\x80", b"\0\0\x01\xe0"), (b"\xf0abc", b"\x90")])]
    got = spark.createDataFrame(rows, "i int, c binary").select(formats.png_megapixels(F.col("c")).alias("m")).collect()
    assert [r["m"] for r in got[:2]] == [float((2**32 - 1) ** 2) / 1e6, 0.3072] and got[2]["m"] == 0xF0616263 * 0x90 / 1e6


def test_error_rate_of_what_stands_in_the_reference(spark):
    """400 outputs within references of 200,000 characters, whose matrices would take minutes; and some that don't stand there."""
    x = spark.range(400).select(F.repeat(F.concat(F.lit("abcdefg hij "), F.col("id").cast("string")), 14_000).alias("ref")).withColumn("out", F.substring("ref", 7, 300))
    began = time.time()
    assert x.where(text.error_rate(F.col("ref"), F.col("out")) == 100.0 * (F.length("ref") - 300) / F.length("ref")).count() == 400 and time.time() - began < 30
    rows = [("abcd", "bd", 50.0), ("abcd", "", 100.0), ("ab", "abab", 100.0), ("", "a", None), ("ab", None, None)]
    assert [r[0] for r in spark.createDataFrame([r[:2] for r in rows], "r string, o string").select(text.error_rate(F.col("r"), F.col("o"))).collect()] == [r[2] for r in rows]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_probes_gather_their_tracks_once_and_show_no_values(spark):
    from siftmark.plans import QUERIES

    plan = _plan(QUERIES["c4_c14_probes"](spark, "/root/testdata/sf0.001"))
    assert plan.count("collect_list(") == 1 and "comparison" not in plan and "array_sort" not in plan


def test_short_findings_are_ranked_without_their_texts(spark):
    from siftmark.plans import QUERIES

    plan = _plan(QUERIES["c25_short"](spark, "/root/testdata/sf0.001"))
    assert "Window" in plan and "message" not in plan.split("Window", 1)[1]
