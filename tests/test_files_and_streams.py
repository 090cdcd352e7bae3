"""Folders of files, logs, signatures of binary headers, and the stateful streams."""

import json

from pyspark.sql import functions as F

from siftmark.functions import formats as fm
from siftmark.functions import signatures as sg
from siftmark.operators import arrivals
from siftmark.sources import files, folders
from siftmark.streaming import arrivals as st

PNG = bytes.fromhex("89504e470d0a1a0a0000000d4948445200000280000001e0") + b"x" * 20 + b"IEND\xaeB`\x82"


def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in {"a.PNG": PNG, "cut.png": PNG[:-12], "b.jpeg": b"\xff\xd8\xff\xe0", "c.txt": "año".encode("latin-1"), "sub/d.MD": "﻿hola".encode(), "e.wav": b"RIFF\x10\x00\x00\x00WAVE", "f.wav": b"RIFF\xff\xff\xff\xffWAVEfmt ", "g.epub": b"PK\x03\x04" + b"\0" * 26 + b"mimetypeapplication/epub+zip", "h.mp4": b"\0\0\0\x1cftypisom", "i.bin": b"ab\0cd", "empty": b""}.items():
        (tmp_path / "in" / name).write_bytes(data)
    return f"file://{tmp_path}/in"


def test_inventory_census_and_candidates(spark, tmp_path):
    at = folder(tmp_path)
    inv = files.inventory(spark, at)
    assert {r["name"]: r["ext"] for r in inv.collect()} == {"a.PNG": "png", "cut.png": "png", "b.jpeg": "jpg", "c.txt": "txt", "d.MD": "md", "e.wav": "wav", "f.wav": "wav", "g.epub": "epub", "h.mp4": "mp4", "i.bin": "bin", "empty": ""}
    assert {r["name"] for r in inv.where("size = 0").collect()} == {"empty"} and {r["name"] for r in files.inventory(spark, at, glob="*.wav").collect()} == {"e.wav", "f.wav"}
    assert {r["name"] for r in files.inventory(spark, at, recursive=False).collect()} == {r["name"] for r in inv.collect()} - {"d.MD"}
    reach = spark.createDataFrame([("png", "pdf"), ("md", "pdf"), ("pdf", "txt")], "origen string, destino string")
    assert {r["name"] for r in files.candidates(inv, reach, "pdf").collect()} == {"a.PNG", "cut.png", "d.MD"}
    assert files.census(spark, at).where("dir LIKE '%/sub'").count() == 1


def test_signatures_and_completeness(spark, tmp_path):
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder(tmp_path))
    c = F.col("content")
    got = {r[0].rsplit("/", 1)[1]: r[1:] for r in raw.select("path", sg.signature(c), fm.declared_length_status(c), fm.png_megapixels(c)).collect()}
    assert got["a.PNG"][0] == "png" and got["a.PNG"][1] == "completo" and got["a.PNG"][2] == 640 * 480 / 1e6
    assert got["cut.png"][1] == "incompleto" and got["e.wav"][:2] == ("wav", "incompleto") and got["f.wav"][1] == "sin_declaracion"
    assert [got[k][0] for k in ("b.jpeg", "g.epub", "h.mp4", "i.bin", "c.txt", "d.MD")] == ["jpeg", "epub", "mp4", "desconocido", "texto", "texto"]


def test_texts_fall_back_to_latin1(spark, tmp_path):
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.texts(spark, folder(tmp_path)).collect()}
    assert got["c.txt"] == "año" and got["d.MD"] == "hola"


def test_probe_documents_and_run_log(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps({"motor": "m1", "build": "1", "huella": {"bin": "x"}, "aristas": [{"origen": "a", "destino": "b", "estado": "real", "ms": 3.0}]}))
    (tmp_path / "p" / "bad.json").write_text("{not json")
    assert [r["motor"] for r in files.probes(spark, str(tmp_path / "p")).collect()] == ["m1"]
    (tmp_path / "log.jsonl").write_text('{"catalogo": "c", "rc": 0}\n{"catalogo": "d", "rc": 1}\n')
    assert [r["catalogo"] for r in files.run_log(spark, str(tmp_path / "log.jsonl")).collect()] == ["c"]


LISTING = "vuelta long, poll timestamp, ruta string, tamano long, mtime timestamp, incompleto boolean"


def append_listings(spark, path, rows):
    """rows (vuelta, ruta, tamano, incompleto): poll k is at minute k."""
    full = [(k, f"2024-01-01 00:{k:02d}:00", ruta, size, "2023-12-31 00:00:00", partial) for k, ruta, size, partial in rows]
    df = spark.createDataFrame(full, "vuelta long, poll string, ruta string, tamano long, mtime string, incompleto boolean")
    df.withColumn("poll", F.col("poll").cast("timestamp")).withColumn("mtime", F.col("mtime").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(path))


def serve(spark, tmp_path, **more):
    """What a run over all listings that are there serves; state goes on from the last run."""
    stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l"))
    q = st.mature(stream, **more).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return sorted((r["ruta"], r["tamano"], r["poll"].minute, r["estado"]) for r in spark.read.schema("ruta string, poll timestamp, tamano long, mtime timestamp, estado string").parquet(str(tmp_path / "out")).collect())


def test_stream_of_listings_goes_on_after_a_restart(spark, tmp_path):
    for k in range(6):
        append_listings(spark, tmp_path / "l", [(k, "quiet", 5, False), (k, "grows", k if k < 4 else 9, False), (k, "partial", 7, True)])
    want = [("grows", 9, 5, "servido"), ("partial", 7, 4, "desistido"), ("quiet", 5, 1, "servido")]
    assert serve(spark, tmp_path, polls=2, patience=3) == want
    append_listings(spark, tmp_path / "l", [(6, "quiet", 5, False), (6, "grows", 10, False)])
    append_listings(spark, tmp_path / "l", [(7, "quiet", 5, False), (7, "grows", 10, False)])
    assert serve(spark, tmp_path, polls=2, patience=3) == sorted([*want, ("grows", 10, 7, "servido")])  # remembered, and counted on


def test_stream_serves_what_batch_serves(spark, tmp_path):
    """A change and back, missed polls (before, at and after the timer), listings that come twice or late: the same
    identities at the same polls as in the batch twin."""
    seen = {"back": [1, 1, 2, 2, 1, 1, 1, 1], "gap": [5, None, 5, None, 5, 5, 5, 5], "long gap": [4, None, None, None, None, 4, 4, 4], "quiet": [3] * 8, "never": [1, 2, 3, 4, 5, 6, 7, 8], "late": [8, None, 8, 8, 9, 9, 9, 9]}
    rows = [(k, ruta, v[k], False) for k in range(8) for ruta, v in seen.items() if v[k] is not None]
    listings = None
    for k in range(8):
        again = [r for r in rows if r[0] == k]
        append_listings(spark, tmp_path / "l", again + (again[:2] if k % 2 else []))  # some come twice
        if k == 3:
            append_listings(spark, tmp_path / "l", [(1, "late", 8, False), (3, "quiet", 3, False)])  # late, and once more
    full = [(k, f"2024-01-01 00:{k:02d}:00", ruta, size, "2023-12-31 00:00:00") for k, ruta, size, _ in rows]
    listings = spark.createDataFrame(full + full[:5], "vuelta long, poll string, ruta string, tamano long, mtime string").withColumn("poll", F.col("poll").cast("timestamp")).withColumn("mtime", F.col("mtime").cast("timestamp"))
    batch = sorted((r["ruta"], r["tamano"], r["servido"].minute, "servido") for r in arrivals.served_once(arrivals.stable_runs(listings)).collect())
    assert serve(spark, tmp_path) == batch == sorted((a, b, c, "servido") for a, b, c in [("back", 1, 1), ("back", 2, 3), ("gap", 5, 5), ("long gap", 4, 6), ("quiet", 3, 1), ("late", 8, 3), ("late", 9, 5)])
    gone = sorted((r["ruta"], r["visto"].minute, r["desalojado"].minute, r["polls"]) for r in arrivals.evictions(arrivals.numbered(listings.drop("vuelta"))).collect())
    assert gone == [("gap", 0, 1, 1), ("gap", 2, 3, 1), ("late", 0, 1, 1), ("long gap", 0, 1, 1)]


def test_orphan_jobs(spark, tmp_path):
    def beat(rows):
        spark.createDataFrame(rows, "job long, ts string, estado string").select("job", F.col("ts").cast("timestamp").alias("ts"), "estado").coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))

    beat([(1, "2024-01-01 00:00:00", "working"), (2, "2024-01-01 00:00:00", "working"), (2, "2024-01-01 00:01:00", "completed")])
    for h in (3, 6, 9):  # each run sees one more heartbeat, which moves the watermark on
        stream = spark.readStream.schema("job long, ts timestamp, estado string").parquet(str(tmp_path / "b"))
        q = st.orphans(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        beat([(3, f"2024-01-01 0{h}:00:00", "completed")])
    assert [(r["job"], r["estado"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "failed")]


def test_headers_read_only_the_ends(spark, tmp_path):
    (tmp_path / "a small.bin").write_bytes(b"GIF89a" + b"x" * 10)
    with open(tmp_path / "a large.bin", "wb") as f:  # a gigabyte that no disk holds
        f.write(b"\x1aE\xdf\xa3" + b"y" * 5000)
        f.truncate(1 << 30)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "locked").write_bytes(b"abc")
    (tmp_path / "_hidden").write_bytes(b"abc")
    found = files.headers(spark, str(tmp_path), n=8, tail=4)
    got = {r["path"].rsplit("/", 1)[1]: (r["size"], bytes(r["head"]), bytes(r["tail"]), r["reason"]) for r in found.collect()}
    assert got == {"a small.bin": (16, b"GIF89axx", b"xxxx", None), "a large.bin": (1 << 30, b"\x1aE\xdf\xa3yyyy", b"\0" * 4, None), "empty": (0, b"", b"", None), "locked": (3, b"abc", b"abc", None)}


def test_limits_reach_the_listing(spark, tmp_path):
    """What is beyond the limits isn't opened; links that lead nowhere are no files."""
    for d in range(3):
        (tmp_path / f"d{d}" / "e").mkdir(parents=True)
        for i in range(40):
            (tmp_path / f"d{d}" / "e" / f"f{i}.{'txt' if i % 2 else 'png'}").write_bytes(b"z" * i)
    (tmp_path / "d0" / "link.mov").symlink_to(tmp_path / "nothing")
    some = folders.folder(spark, str(tmp_path), head=1, least_size=30, most_size=38, exts=["png"], glob="f3*")
    assert sorted(r["name"] for r in some.collect()) == sorted([f"f{i}.png" for i in range(30, 40, 2)] * 3)
    all_ = folders.folder(spark, str(tmp_path), head=1)
    assert all_.where("size > 38").count() == 3 and all_.count() == 120 and all_.select("dir").distinct().count() == 3


def test_readers_deal_out_stretches_and_folders(tmp_path):
    for d in range(4):
        (tmp_path / f"d{d}").mkdir()
        for i in range(7):
            (tmp_path / f"d{d}" / f"f{i}").write_bytes(b"z" * i)
    (tmp_path / "top").write_bytes(b"x")
    reader = folders.FolderReader({"path": str(tmp_path), "head": "2"})
    old = folders.FOLDERS, folders.DEALT_FILES
    try:
        folders.FOLDERS, folders.DEALT_FILES = 2, 3
        parts = reader.partitions()
        assert [len(p.files) for p in parts if p.folder is None] == [1] and len([p for p in parts if p.folder]) == 4  # tasks list the rest
        folders.FOLDERS = 100
        flat = reader.partitions()
        assert [len(p.files) for p in flat] == [3] * 9 + [2] and all(p.folder is None for p in flat)
        rows = lambda ps: sorted(tuple(r.values())[:3] + (r["size"], r["head"]) for p in ps for b in reader.read(p) for r in b.to_pylist())
        assert rows(parts) == rows(flat) and len(rows(flat)) == 29
    finally:
        folders.FOLDERS, folders.DEALT_FILES = old


ZIP_TAIL = b"PK\x01\x02" + b"\0" * 42


def test_every_mark_is_told_apart(spark):
    """Each mark alone in a file shows its type, unless one before it in the table fits as well; and the containers."""
    rows = []
    for m in sg.MARKS:
        data = b"-" * m.offset + m.bytes
        first = next(x.kind for x in sg.MARKS if data[x.offset : x.offset + len(x.bytes)] == x.bytes)
        rows.append((data, first))
    assert len(rows) > 120 and sum(k == m.kind for (_, k), m in zip(rows, sg.MARKS)) == len(rows)
    three = b"MM\x0a\x00\x00\x00abcd"
    rows += [
        (b"", "vacio"), (b"RIFFxxxxRMID", "midi"), (b"RIFFxxxxABCD", "riff"), (b"RF64", "wav"), (sg.WAVE64, "wave64"), (b"FORMxxxxAIFC", "aiff"), (b"FORMxxxxILBM", "iff"), (b"xxxxftypheic", "heif"), (b"xxxxftyp????", "isobmff"),
        (b"t".ljust(60, b"\0") + b"PNRdPPrs", "ereader"), (b"PK\x05\x06", "zip"), (b"PK\x03\x04" + b"\0" * 26 + b"[Content_Types].xml" + ZIP_TAIL + b"word/document.xml", "docx"), (b"PK\x03\x04" + b"\0" * 26 + b"x" + ZIP_TAIL + b"xl/a", "xlsx"),
        (b"PK\x03\x04" + b"\0" * 26 + b"aPK\x03\x04" + b"\0" * 26 + b"mimetypeapplication/vnd.oasis.opendocument.spreadsheet", "ods"), (sg.CFB, "cfb"), (three, "3ds"), (three + b"e", "desconocido"), (b"P4\n", "pnm"), (b"P7 ", "pam"), (b"PF\n", "pfm"), (b"P8\n", "texto"),
        (b"\x0a\x05\x01\x08", "pcx"), (b"\x0a\x01\x01\x08", "desconocido"), (b"G" + b"\x01" * 187 + b"G", "mpegts"), (b"\x01" * 4 + b"G" + b"\x01" * 191 + b"G", "m2ts"), (b"\0\0\1\x09", "flujo_es"), (b"\xff\xf1", "adts"), (b"\xff\xf9", "adts"), (b"\xff\xfb", "mpegaudio"), (b"\xff\xe2", "mpegaudio"),
        (b"\xef\xbb\xbf \n<?xml version='1'?><svg>", "svg"), (b"<!DOCTYPE HTML>", "html"), (b"a\x00b", "desconocido"), (b"caf\xe9", "texto"), (b"a" * 600 + b"\x01", "texto"), (b"a" * 500 + b"\x01", "desconocido"),
    ]
    got = spark.createDataFrame([(i, bytearray(d)) for i, (d, _) in enumerate(rows)], "i int, c binary").select("i", sg.signature(F.col("c")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: k for i, (_, k) in enumerate(rows)}
    assert spark.createDataFrame([(None,)], "c binary").select(sg.signature(F.col("c"))).first()[0] is None


def test_extensions_accept_what_their_types_show(spark):
    rows = [("jpg", "jpeg", True), ("png", "jpeg", False), ("flac", "flac", True), ("docx", "zip", True), ("xyz", "png", None), ("html", "texto", True), ("rgb", "texto", None), ("qoi", "qoi", True)]
    got = spark.createDataFrame(rows, "e string, k string, w boolean").select("e", fm.coherent(F.col("k"), F.col("e")).alias("c"), "w", fm.signature_status(F.col("e")).alias("s")).collect()
    assert all(r["c"] == r["w"] for r in got)
    assert {r["e"]: r["s"] for r in got} == {"jpg": "evaluado", "png": "evaluado", "flac": "evaluado", "docx": "evaluado", "xyz": "sin_vocabulario", "html": "familia", "rgb": "no_aplica", "qoi": "evaluado"}


def test_runs_follow_from_changes_without_a_row_for_each_poll(spark, tmp_path):
    """As stable_runs() has them, from listings that hold every file at every poll; and as the SQL has them, where a user is null."""
    import random

    import duckdb

    from siftmark.plans import ORACLE, QUERIES

    r = random.Random(5)
    polls = sorted(r.sample(range(60), 30))
    changes = {(f, h): (k + 1, h - 1) for f in range(12) for k, h in enumerate(sorted(r.sample(range(62), r.randint(1, 20))))}
    listed = [(p, f, *changes[max(x for x in changes if x[0] == f and x[1] <= p)]) for f in range(12) for p in polls if any(x[0] == f and x[1] <= p for x in changes)]
    listings = spark.createDataFrame(listed, "poll long, ruta long, tamano long, mtime long")
    got = arrivals.runs_of_changes(spark.createDataFrame([(*k, *v) for k, v in changes.items()], "ruta long, hora long, tamano long, mtime long"), spark.createDataFrame([(p,) for p in [*polls, *polls[:5]]], "poll long"), 3)
    key = lambda x: str(tuple(x[c] for c in ("ruta", "tamano", "mtime", "desde", "maduro", "n")))
    assert sorted(map(key, got.collect())) == sorted(map(key, arrivals.stable_runs(listings, 3).collect()))

    events = [(k, f"2024-01-0{1 + k % 3} {k % 24:02d}:{'00' if k % 5 == 0 else '17'}:00", None if k % 7 == 0 else k % 6, "purchase", 1.0, "{}") for k in range(120)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("f1_f2_stable", "f3_served_once", "f4_patience"):
        got = QUERIES[name](spark, str(tmp_path)).toPandas()
        want = duck.execute(ORACLE[name]).df()[list(got.columns)]
        assert sorted(map(str, got.astype(object).values.tolist())) == sorted(map(str, want.astype(object).values.tolist())), name
