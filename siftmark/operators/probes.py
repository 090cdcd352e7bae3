"""The contract over whole probes: what a file's container and tracks say, against its input and what was asked.

A pair holds three structs: entrada and salida (PROBE) and pedido (ASKED). Everything may be null: not measured, or not asked.
Rules look at tracks by kind, so one row holds a file whatever number of tracks it has.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media
from .contract import AUDIO_RATE_FAIL, AUDIO_RATE_WARN, ASPECT_DRIFT, DEPTH_LIMIT, DEPTHS, FAIL, INFO, NO_ALPHA, VIDEO_RATE_DRIFT, WARN, Rule

TRACK = "struct<tipo:string,codec:string,canales:int,sample_rate:int,ancho:int,alto:int,dur:double,bits:int,bitrate_bps:double>"
PROBE = f"struct<categoria:string,ancho:int,alto:int,bits:int,alfa:boolean,alfa_min:int,dur:double,ppp:double,ancho_pt:double,paginas:int,comprimido:boolean,bitrate_bps:double,pistas:array<{TRACK}>>"
ASKED = "struct<destino:string,flujos:struct<video:int,audio:int,subtitulo:int>,solo_audio:boolean,solo_video:boolean,recortar:boolean,ancho:int,alto:int,dpi:int,bits:int,fps:double,sample_rate:int,canales:int,bitrate_video_bps:double,bitrate_bps:double>"
# Track kinds and the rules that count them; codecs that keep every sample; thresholds.
KINDS = {"video": "V7", "audio": "V3", "subtitulo": "V4"}
LOSSLESS = ("flac", "alac", "pcm_s16le", "pcm_s24le", "pcm_s32le", "pcm", "wavpack", "tta", "truehd")
VIDEO_TOLERANCE, RATES = 0.050, (8000, 192000)
DPI_OFF, PIXELS_OFF, POINTS_OFF, ABSURD_PX = 1, 1, 1.5, 1000



def _pair() -> tuple[Column, Column, Column]:
    """Input, output and request of a row."""
    return F.col("entrada"), F.col("salida"), F.col("pedido")


def prepared(pairs: DataFrame) -> DataFrame:
    """pairs with their tracks by kind, worked out once for all rules (_entrada_audio and so on)."""
    empty = F.array().cast(f"array<{TRACK}>")

    def of(file: str, kind: str) -> Column:
        return F.filter(F.coalesce(F.col(file)["pistas"], empty), lambda t: t["tipo"] == kind)

    return pairs.withColumns({f"_{file}_{kind}": of(file, kind) for file in ("entrada", "salida") for kind in KINDS})


def tracks(file: str, kind: str) -> Column:
    return F.col(f"_{file}_{kind}")


def first(file: str, kind: str, field: str) -> Column:
    """A field of the first track of a kind that has it."""
    return F.get(F.filter(F.transform(tracks(file, kind), lambda t: t[field]), lambda x: x.isNotNull() & (x != 0)), 0)


def _is(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _both(kind: str) -> Column:
    e, s, _ = _pair()
    return _is((s["categoria"] == kind) & (e["categoria"] == kind))


def _size(name: str) -> tuple[Column, Column]:
    """Width and height of an image, else of the first video track that has them."""
    file, video = F.col(name), F.get(F.filter(tracks(name, "video"), lambda t: F.coalesce(t["ancho"], F.lit(0)) > 0), 0)
    whole = F.coalesce(file["ancho"], F.lit(0)) > 0
    return F.when(whole, file["ancho"]).otherwise(video["ancho"]), F.when(whole, file["alto"]).otherwise(video["alto"])


def _bits(file: Column) -> Column:
    return F.coalesce(F.when(file["bits"] > 0, file["bits"]), F.get(F.filter(F.transform(file["pistas"], lambda t: t["bits"]), lambda b: b > 0), 0))


def track_counts() -> list[Rule]:
    """Point 2: tracks of each kind. Expected is what was asked, else the input's, but for targets that hold one kind only;
    fewer fail, more warn; with nothing to compare with, one informative finding."""
    e, s, p = _pair()
    said, known = p["flujos"], e["categoria"] == "av"
    av = _is(s["categoria"] == "av")
    one = {"video": 1, "audio": 0, "subtitulo": 0}
    sound = {"video": 0, "audio": 1, "subtitulo": 0}
    out = [Rule("V3-sin", 2, F.when(av & said.isNull() & ~_is(known), INFO), F.lit(None), F.lit(None), "no input to compare tracks with")]
    for kind, name in KINDS.items():
        like = F.size(tracks("entrada", kind))
        like = F.when(_is(p["solo_video"]), like if kind == "video" else F.lit(0)).when(_is(p["solo_audio"]), F.lit(sound[kind])).when(p["destino"] == "gif", F.lit(one[kind])).otherwise(like)
        expected = F.when(said.isNotNull(), F.coalesce(said[kind], F.lit(0))).when(_is(known), like)
        got = F.size(tracks("salida", kind))
        out.append(Rule(name, 2, F.when(av & (got < expected), FAIL).when(av & (got > expected), WARN), expected, got, f"tracks: {kind}"))
    return out


def integrity() -> list[Rule]:
    """Point 3: what a file of its kind must say of itself."""
    e, s, p = _pair()
    cat = lambda k: _is(s["categoria"] == k)
    none = F.lit(None)
    w, h = F.coalesce(s["ancho"], F.lit(0)), F.coalesce(s["alto"], F.lit(0))
    sound, video = tracks("salida", "audio"), tracks("salida", "video")
    return [
        Rule("G4-size", 3, F.when(cat("imagen"), F.when((w == 0) | (h == 0), FAIL).when((w < 2) | (h < 2), WARN)), F.lit(2), w, "dimensions"),
        Rule("G4-depth", 3, F.when(cat("imagen") & s["bits"].isNotNull() & ~s["bits"].isin(*DEPTHS), WARN), none, s["bits"], "odd depth"),
        Rule("G4-duration", 3, F.when(cat("av") & ~_is(s["dur"] > 0), FAIL), F.lit(0), s["dur"], "duration"),
        Rule("G4-tracks", 3, F.when(cat("av") & (F.size(F.coalesce(s["pistas"], F.array().cast(f"array<{TRACK}>"))) == 0), FAIL), F.lit(1), F.lit(0), "no tracks"),
        Rule("A2-none", 3, F.when(cat("av") & F.exists(sound, lambda t: F.coalesce(t["canales"], F.lit(0)) == 0), WARN), none, none, "audio without channels"),
        Rule("A3-odd", 3, F.when(cat("av") & F.exists(sound, lambda t: (t["sample_rate"] > 0) & ~t["sample_rate"].between(*RATES)), WARN), none, none, "odd sample rate"),
        Rule("V7-size", 3, F.when(cat("av") & F.exists(video, lambda t: (F.coalesce(t["ancho"], F.lit(0)) == 0) | (F.coalesce(t["alto"], F.lit(0)) == 0)), FAIL), none, none, "video without size"),
        Rule("G4-rate", 3, F.when(cat("av") & (s["bitrate_bps"] <= 0), WARN), F.lit(0), s["bitrate_bps"], "bit rate"),
        Rule("P1-pages", 3, F.when(cat("pdf") & (F.coalesce(s["paginas"], F.lit(0)) == 0), F.when(_is(s["comprimido"]), WARN).otherwise(FAIL)), F.lit(1), s["paginas"], "pages"),
    ]


def _lossy_frames(file: str) -> Column:
    return F.transform(tracks(file, "audio"), lambda t: F.struct(t["codec"].alias("codec"), F.when(t["sample_rate"] > 0, t["sample_rate"]).alias("sample_rate")))


def durations() -> Rule:
    """With sound alone asked for, the first audio tracks are compared, not the files. Cuts and other frame rates excuse."""
    e, s, p = _pair()
    alone = _is(p["solo_audio"])
    side = lambda f: F.when(alone, F.coalesce(first(f, "audio", "dur"), F.col(f)["dur"])).otherwise(F.col(f)["dur"])
    before, after = side("entrada"), side("salida")
    tolerance = F.when(F.size(tracks("salida", "video")) > 0, VIDEO_TOLERANCE).otherwise(media.duration_tolerance(F.concat(_lossy_frames("salida"), _lossy_frames("entrada")), F.lit(False)))
    sure = (before > 0) & (after > 0) & ~_is(p["recortar"]) & p["fps"].isNull()
    return Rule("A1/V1", 4, F.when(sure & (F.abs(after - before) > tolerance), FAIL), F.round(before, 4), F.round(after, 4), "duration drift")


def asked() -> list[Rule]:
    """Point 4: what was asked must be there, and what wasn't asked must not have changed."""
    e, s, p = _pair()
    (w, h), (w0, h0) = _size("salida"), _size("entrada")
    resized = p["ancho"].isNotNull() | p["alto"].isNotNull() | p["dpi"].isNotNull()
    dpi, bits, bits0 = p["dpi"], _bits(s), _bits(e)
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in DEPTH_LIMIT.items() for x in kv]), p["destino"])
    sound = lambda f, field: first(f, "audio", field)
    rate0, rate, lost = sound("entrada", "sample_rate"), sound("salida", "sample_rate"), _is(e["alfa"]) & ~_is(s["alfa"])
    codec = F.get(F.filter(tracks("salida", "audio"), lambda t: t["sample_rate"] > 0), 0)["codec"]
    drift = (s["bitrate_bps"] - p["bitrate_video_bps"]) / p["bitrate_video_bps"]
    off = F.abs(sound("salida", "bitrate_bps") - p["bitrate_bps"]) / p["bitrate_bps"]
    points = w0 * 72.0 / dpi
    return [
        Rule("I1/V7", 4, F.when(~resized & ~_is(e["categoria"] == "pdf") & ((w != w0) | (h != h0)), FAIL), w0, w, "resized without being asked"),
        Rule("I1", 4, F.when((p["ancho"] > 0) & ((w != p["ancho"]) | ((p["alto"] > 0) & (h != p["alto"]))), FAIL), p["ancho"], w, "not the size asked for"),
        Rule("I1-aspect", 4, F.when(~resized & ~_is(p["recortar"]) & (F.abs(w / h - w0 / h0) > ASPECT_DRIFT), WARN), F.round(w0 / h0, 3), F.round(w / h, 3), "aspect ratio moved"),
        Rule("P4-dpi", 4, F.when(_is(s["categoria"] == "imagen") & (s["ppp"] > 0) & (F.abs(s["ppp"] - dpi) > DPI_OFF), FAIL), dpi, s["ppp"], "density"),
        Rule("P4-px", 4, F.when(_is((e["categoria"] == "pdf") & (s["categoria"] == "imagen")) & (F.abs(w - F.round(e["ancho_pt"] * dpi / 72.0)) > PIXELS_OFF), FAIL), F.round(e["ancho_pt"] * dpi / 72.0), w, "pixels for points"),
        Rule("I5", 4, F.when(_both("imagen") & (bits < bits0) & ~_is(p["bits"] == bits), F.when(bits <= limit, INFO).otherwise(FAIL)), bits0, bits, "depth fell"),
        Rule("A6", 4, F.when(_is(s["categoria"] == "av") & (bits > bits0) & F.exists(tracks("salida", "audio"), lambda t: media.codec(t["codec"]).isin(*LOSSLESS)), WARN), bits0, bits, "depth rose without new information"),
        Rule("I2", 4, F.when(_both("imagen") & lost, F.when(e["alfa_min"].isNull(), INFO).when(e["alfa_min"] < 255, F.when(p["destino"].isin(*NO_ALPHA), INFO).otherwise(FAIL))), e["alfa_min"], s["alfa"], "alpha lost"),
        durations(),
        Rule("A3", 4, F.when(p["sample_rate"].isNull() & (rate != rate0), F.when(_is(F.lower(codec).contains("opus")) & (rate == 48000), INFO).otherwise(FAIL)), rate0, rate, "sample rate changed"),
        Rule("A2", 4, F.when(p["canales"].isNull() & (sound("salida", "canales") != sound("entrada", "canales")), FAIL), sound("entrada", "canales"), sound("salida", "canales"), "channels changed"),
        Rule("V10", 4, F.when(F.size(tracks("salida", "video")) > 0, F.when(drift < -VIDEO_RATE_DRIFT, FAIL).when(drift > VIDEO_RATE_DRIFT, F.when(F.size(tracks("salida", "audio")) == 0, FAIL).otherwise(INFO))), p["bitrate_video_bps"], s["bitrate_bps"], "video bit rate"),
        Rule("A-rate", 4, F.when(off > AUDIO_RATE_FAIL, FAIL).when(off > AUDIO_RATE_WARN, WARN), p["bitrate_bps"], sound("salida", "bitrate_bps"), "audio bit rate"),
        Rule("P7-box", 4, F.when(_is((s["categoria"] == "pdf") & (e["categoria"] == "imagen")) & dpi.isNotNull() & (F.abs(s["ancho_pt"] - points) > POINTS_OFF), FAIL), F.round(points, 1), s["ancho_pt"], "page box against density"),
        Rule("P7", 4, F.when(_is((s["categoria"] == "pdf") & (e["categoria"] == "imagen")) & dpi.isNull() & (F.abs(s["ancho_pt"] - w0) < 1.0) & (w0 > ABSURD_PX), WARN), F.lit(None), s["ancho_pt"], "one pixel a point"),
        Rule("P1", 4, F.when(_both("pdf") & (e["paginas"] > 0) & (s["paginas"] > 0) & (e["paginas"] != s["paginas"]), FAIL), e["paginas"], s["paginas"], "page count changed"),
    ]


def media_rules() -> list[Rule]:
    """Points 2 to 4 of the contract, in order, for prepared() pairs."""
    return track_counts() + integrity() + asked()
