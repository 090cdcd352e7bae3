"""A file's type by its bytes: a table of marks, containers told apart by what they hold, patterns, then text."""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 512  # bytes that decide whether a file is text
HEAD = 2056  # bytes that hold every mark


class Mark(NamedTuple):
    offset: int
    bytes: bytes
    kind: str


# What stands at an offset, and the type that it shows; of those that fit, the first counts.
MARKS = (
    Mark(0, b"\x89PNG\r\n\x1a\n", "png"),
    Mark(0, b"\x8aMNG\r\n\x1a\n", "mng"),
    Mark(0, b"\x8bJNG\r\n\x1a\n", "jng"),
    Mark(0, b"\xff\xd8\xff", "jpeg"),
    Mark(0, b"\x00\x00\x00\x0cjP  \r\n\x87\n", "jpeg2000"),
    Mark(0, b"\xff\x4f\xff\x51", "jpeg2000"),
    Mark(0, b"\x00\x00\x00\x0cJXL \r\n\x87\n", "jxl"),
    Mark(0, b"\xff\x0a", "jxl"),
    Mark(0, b"GIF87a", "gif"),
    Mark(0, b"GIF89a", "gif"),
    Mark(0, b"BM", "bmp"),
    Mark(0, b"II*\x00", "tiff"),
    Mark(0, b"MM\x00*", "tiff"),
    Mark(0, b"II+\x00", "bigtiff"),
    Mark(0, b"MM\x00+", "bigtiff"),
    Mark(0, b"8BPS", "psd"),
    Mark(0, b"\x01\xda", "sgi"),
    Mark(0, b"\x59\xa6\x6a\x95", "sunras"),
    Mark(0, b"DDS ", "dds"),
    Mark(0, b"v/1\x01", "exr"),
    Mark(0, b"#?RADIANCE", "radiance"),
    Mark(0, b"#?RGBE", "radiance"),
    Mark(0, b"SDPX", "dpx"),
    Mark(0, b"XPDS", "dpx"),
    Mark(0, b"\x80\x2a\x5f\xd7", "cineon"),
    Mark(0, b"\xb1\x68\xde\x3a", "dcx"),
    Mark(0, b"\x00\x00\x01\x00\x00\x00", "jbig"),
    Mark(0, b"\x00\x00\x01\x00", "ico"),
    Mark(0, b"\x00\x00\x02\x00\x00\x00", "desconocido"),
    Mark(0, b"\x00\x00\x02\x00", "cur"),
    Mark(0, b"qoif", "qoi"),
    Mark(0, b"farbfeld", "farbfeld"),
    Mark(0, b"id=ImageMagick", "miff"),
    Mark(0, b"id=MagickPixelCache", "mpc"),
    Mark(0, b"id=MagickCache", "mpc"),
    Mark(0, b"\xab\x01\x01\x03", "viff"),
    Mark(0, b"\xff\x57\x50\x43", "wpg"),
    Mark(0, b"SIMPLE  =", "fits"),
    Mark(0, b"LBLSIZE=", "vicar"),
    Mark(0, b"iiii\x04\x00\x00\x00", "ipl"),
    Mark(0, b"\xd7\xcd\xc6\x9a", "wmf"),
    Mark(0, b"gimp xcf ", "xcf"),
    Mark(0, b"MATLAB 5.0", "mat"),
    Mark(0, b"srcdocid:", "cals"),
    Mark(0, b"PG ML", "pgx"),
    Mark(0, b"\x1bP", "sixel"),
    Mark(0, b"\x1bE\x1b", "pcl"),
    Mark(0, b"\x08\xf2\xa6\xb6", "vips"),
    Mark(0, b"\xb6\xa6\xf2\x08", "vips"),
    Mark(4, b"\x00\x00\x00\x07\x00\x00\x00\x02", "xwd"),
    Mark(0, b"fLaC", "flac"),
    Mark(0, b"OggS", "ogg"),
    Mark(0, b"ID3", "mp3"),
    Mark(0, b"caff", "caf"),
    Mark(0, b".snd", "au"),
    Mark(0, b"wvpk", "wavpack"),
    Mark(0, b"TTA1", "tta"),
    Mark(0, b"MAC ", "ape"),
    Mark(0, b"MPCK", "musepack"),
    Mark(0, b"MP+", "musepack"),
    Mark(0, b"Creative Voice File", "voc"),
    Mark(0, b".SoX", "sox"),
    Mark(0, b"\x64\xa3\x01\x00", "ircam"),
    Mark(0, b"\x00\x01\x00\x00MThd", "midi"),
    Mark(0, b"MThd", "midi"),
    Mark(0, b"#!AMR", "amr"),
    Mark(0, b"ALP ", "alp"),
    Mark(0, b"STRM\x00", "ast"),
    Mark(0, b"KVAG", "vag"),
    Mark(0, b"FL32", "fl32"),
    Mark(0, b"\x80\x00\x00\x20\x03", "adx"),
    Mark(0, b"\x0b\x77", "ac3"),
    Mark(0, b"\x7f\xfe\x80\x01", "dts"),
    Mark(0, b"\x00\x00\x02\x80\x01\x01", "dnxhd"),
    Mark(0, b"\x1a\x45\xdf\xa3", "matroska"),
    Mark(0, b"0&\xb2u\x8ef\xcf\x11", "asf"),
    Mark(0, b"FLV\x01", "flv"),
    Mark(0, b".RMF", "realmedia"),
    Mark(0, b"\x06\x0e+4\x02\x05\x01\x01", "mxf"),
    Mark(0, b"nut/multimedia", "nut"),
    Mark(0, b"DKIF", "ivf"),
    Mark(0, b"YUV4MPEG2", "y4m"),
    Mark(0, b"\x12\x00\x0a", "av1obu"),
    Mark(0, b"#EXTM3U", "m3u8"),
    Mark(0, b"WEBVTT", "vtt"),
    Mark(0, b"[Script Info]", "ass"),
    Mark(0, b";FFMETADATA", "ffmetadata"),
    Mark(0, b"/* XPM */", "xpm"),
    Mark(0, b"#define ", "xbm"),
    Mark(0, b"FWS", "swf"),
    Mark(0, b"CWS", "swf"),
    Mark(0, b"ZWS", "swf"),
    Mark(0, b"BBCD", "dirac"),
    Mark(0, b"\xb7\xd8\x00 7I\xda\x11", "wtv"),
    Mark(0, b"FILM\x00\x00", "cpk"),
    Mark(0, b"\x72\xf8\x1f\x4e", "spdif"),
    Mark(40, b" EMF", "emf"),
    Mark(0, b"\x00\x00\x01\xba", "mpegps"),
    Mark(0, b"\x00\x00\x01\xb3", "mpegvideo"),
    Mark(0, b"%PDF-", "pdf"),
    Mark(0, b"%!PS", "postscript"),
    Mark(0, b"\xc5\xd0\xd3\xc6", "eps_binario"),
    Mark(0, b"{\\rtf", "rtf"),
    Mark(0, b"\x1f\x8b", "gzip"),
    Mark(0, b"BZh", "bzip2"),
    Mark(0, b"\xfd7zXZ\x00", "xz"),
    Mark(0, b"7z\xbc\xaf\x27\x1c", "7z"),
    Mark(0, b"Rar!\x1a\x07", "rar"),
    Mark(0, b"AT&TFORM", "djvu"),
    Mark(0, b"ITOLITLS", "lit"),
    Mark(0, b"SNBP000B", "snb"),
    Mark(0, b"!!8-Bit!!", "tcr"),
    Mark(0, b"L\x00R\x00F\x00", "lrf"),
    Mark(0, b"\xb0\x0c\xb0\x0c\x02\x00NUVO", "rocketbook"),
    Mark(0, b"glTF", "glb"),
    Mark(0, b"ply\n", "ply"),
    Mark(0, b"ASSIMP.binary", "assbin"),
    Mark(0, b"AssimpScene\x00", "stl_binario"),
    Mark(0, b"Kaydara FBX Binary", "fbx"),
    Mark(0, b"ISO-10303-21;", "step"),
    Mark(0, b"xof ", "directx_x"),
    Mark(0, b"Width: ", "brf"),
    Mark(522, b"\x00\x11\x02\xff\x0c\x00", "pict"),
    Mark(2048, b"PCD_IPI", "pcd"),
)
# Patterns over the bytes in hexadecimal, tried in this order where no mark fits. The last two: eleven bits
# of a frame's start, told apart by the layer's two bits.
PATTERNS = (
    ("^503[1-6](20|09|0D|0A)", "pnm"),
    ("^5037(20|09|0D|0A)", "pam"),
    ("^50(46|66|48|68)(20|09|0D|0A)", "pfm"),
    ("^0A0[02345]0[01]0[1248]", "pcx"),
    ("^47(..){187}47", "mpegts"),
    ("^(..){4}47(..){191}47", "m2ts"),
    ("^(00)?000001", "flujo_es"),
    ("^FF[EF][0189]", "adts"),
    ("^FF[EF]", "mpegaudio"),
)
# What containers show at the eighth byte, at the sixtieth, or in their first member.
RIFF = {"WEBP": "webp", "WAVE": "wav", "AVI ": "avi", "RMID": "midi"}
FORM = {"AIFF": "aiff", "AIFC": "aiff"}
BRANDS = {
    "avif": "avif", "avis": "avif", "mif1": "heif", "heic": "heif", "heix": "heif", "hevc": "heif", "msf1": "heif",
    "isom": "mp4", "iso2": "mp4", "iso4": "mp4", "iso5": "mp4", "iso6": "mp4", "mp41": "mp4", "mp42": "mp4", "mp71": "mp4",
    "dash": "mp4", "avc1": "mp4", "isml": "mp4", "MSNV": "mp4", "f4v ": "mp4", "mmp4": "mp4", "M4V ": "mp4", "M4VH": "mp4",
    "M4VP": "mp4", "M4P ": "mp4", "M4B ": "m4a", "M4A ": "m4a", "qt  ": "mov", "3gp4": "3gp", "3gp5": "3gp", "3gp6": "3gp",
    "3g2a": "3gp", "3g2b": "3gp", "3gr6": "3gp", "jp2 ": "jpeg2000", "jpx ": "jpeg2000", "jpm ": "jpeg2000", "mj2s": "mj2", "crx ": "isobmff",
}
PALM = {"BOOKMOBI": "mobi", "TEXtREAd": "mobi", "vIMGView": "palm_imagen", "PNRdPPrs": "ereader"}
ZIP_MIME = {
    "application/epub+zip": "epub",
    "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "application/vnd.oasis.opendocument.presentation": "odp",
    "application/vnd.oasis.opendocument.graphics": "odg",
}
ZIP_MEMBERS = {"word/": "docx", "xl/": "xlsx", "ppt/": "pptx"}
TEXT_MARKS = (
    ("%!PS", "postscript"), ("%PDF-", "pdf"), ("{\\rtf", "rtf"), ("#EXTM3U", "m3u8"), ("WEBVTT", "vtt"), ("[Script Info]", "ass"), ("YUV4MPEG2", "y4m"), (";FFMETADATA", "ffmetadata"),
    ("/* XPM */", "xpm"), ("/* UIL */", "uil"), ("#define ", "xbm"), ("# ImageMagick pixel enumeration", "im_texto"), ("GIMP Palette", "gimp_paleta"), ("#FIG ", "xfig"), ("ply\n", "ply"),
    ("solid ", "stl_ascii"), ("#?RADIANCE", "radiance"), ("ISO-10303-21;", "step"),
)
# Which probe reads a type.
PROBE = {
    "imagen": (
        "png", "jpeg", "webp", "gif", "tiff", "avif", "heif", "bmp", "bigtiff", "jpeg2000", "jxl", "psd", "sgi", "sunras", "dds", "exr", "radiance", "dpx", "cineon", "pcx", "dcx", "ico", "cur", "qoi",
        "farbfeld", "miff", "mpc", "viff", "wpg", "fits", "vicar", "ipl", "wmf", "xcf", "mat", "cals", "pgx", "sixel", "jbig", "vips", "mng", "jng", "pnm", "pam", "pfm", "xpm", "xbm", "pict", "pcd", "palm_imagen",
    ),
    "av": (
        "mp4", "m4a", "mov", "matroska", "ogg", "wav", "flac", "mp3", "mpegaudio", "adts", "ac3", "wave64", "aiff", "au", "caf", "wavpack", "tta", "ape", "musepack", "voc", "sox", "ircam", "midi", "amr", "adx",
        "ast", "vag", "fl32", "dts", "dnxhd", "avi", "asf", "flv", "realmedia", "mxf", "nut", "ivf", "swf", "dirac", "wtv", "mpegps", "mpegvideo", "mpegts", "m2ts", "flujo_es", "y4m", "3gp", "mj2", "iff",
    ),
    "pdf": ("pdf",),
    "datos": ("texto", "im_texto", "m3u8", "vtt", "ass", "ffmetadata", "brf", "uil"),
    "documento": (
        "postscript", "rtf", "xml", "html", "svg", "djvu", "mobi", "lit", "snb", "tcr", "lrf", "epub", "rocketbook", "ereader", "docx", "xlsx", "pptx", "odt", "ods", "odp", "odg", "cfb", "eps_binario",
    ),
}
CFB = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
WAVE64 = b"riff\x2e\x91\xcf\x11"


def mapped(key: Column, pairs: dict) -> Column:
    """The value of a key in a small fixed table; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key) if pairs else F.lit(None)


def _latin(content: Column, at: int, n: int) -> Column:
    return F.decode(F.substring(content, at + 1, n), "ISO-8859-1")


def by_marks(content: Column, marks: tuple[Mark, ...] = MARKS) -> Column:
    """The type of the first mark that fits, null if none does: one look-up for each offset and length that marks have, of which
    the mark that comes first in the table decides."""
    groups: dict[tuple[int, int], dict[str, tuple[int, str]]] = {}
    for rank, m in enumerate(marks):
        groups.setdefault((m.offset, len(m.bytes)), {}).setdefault(m.bytes.hex().upper(), (rank, m.kind))
    near = max(m.offset + len(m.bytes) for m in marks if m.offset + len(m.bytes) <= 64)
    start = F.hex(F.substring(content, 1, near))

    def found(offset: int, n: int, kinds: dict) -> Column:
        key = F.substring(start, 2 * offset + 1, 2 * n) if offset + n <= near else F.hex(F.substring(content, offset + 1, n))
        return F.element_at(F.create_map(*[x for k, (rank, kind) in kinds.items() for x in (F.lit(k), F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))]), key)

    return F.array_min(F.array(*[found(offset, n, kinds) for (offset, n), kinds in groups.items()]))["kind"]


def text_type(text: Column) -> Column:
    """The kind of a text by its marker, after a byte order mark and white space; 'texto' if none."""
    bare = F.regexp_replace(text, "^(\\uFEFF|\\u00EF\\u00BB\\u00BF)?[ \\t\\r\\n]*", "")

    def told(s: Column, low: Column) -> Column:
        out = reduce(lambda w, m: w.when(s.startswith(m[0]), m[1]), TEXT_MARKS, F.when(F.lit(False), ""))
        xml = F.when(low.contains("<svg"), "svg").when(low.contains("<html") | low.contains("<!doctype html"), "html").otherwise("xml")
        out = out.when(low.startswith("<?xml"), xml).when(low.startswith("<!doctype html") | low.startswith("<html"), "html").when(low.startswith("<svg"), "svg")
        return out.otherwise("texto")

    one = F.array(F.struct(bare.alias("s"), F.lower(F.substring(bare, 1, 600)).alias("low")))  # bound once, not evaluated anew for each branch
    return F.get(F.transform(one, lambda x: told(x["s"], x["low"])), 0)


def zip_type(content: Column) -> Column:
    """What a ZIP holds: by a first member `mimetype`, else by the names of members in its directory or before their data
    (as far as content goes), else by a later member `mimetype` that is stored as it is; 'zip' if nothing tells."""
    mime = lambda x: reduce(lambda w, kv: w.when(x.startswith(kv[0]), kv[1]), ZIP_MIME.items(), F.when(F.lit(False), ""))
    all_ = F.decode(content, "ISO-8859-1")
    out = F.when(_latin(content, 30, 8) == "mimetype", mime(_latin(content, 38, 80)))
    for member, kind in ZIP_MEMBERS.items():
        name = member.replace("/", r"\/")
        named = F.when(all_.rlike(rf"(?s)PK\x01\x02.{{42}}{name}|PK\x03\x04.{{26}}{name}"), kind)
        out = F.coalesce(out, named)
    later = F.regexp_extract(all_, r"(?s)PK\x03\x04.{26}mimetype(application/[a-z.+]+)", 1)
    return F.coalesce(out, mime(later), F.lit("zip"))


def signature(content: Column, size: Column | None = None) -> Column:
    """A file's type by its bytes: containers, then the marks, then patterns, then whether it is text.

    content: the file, or 2,056 bytes of it and more; members of a ZIP are looked for in all that is given. size: of the
    whole file, by default of content. Null content has no type.
    """
    size = F.length(content) if size is None else size
    window = F.substring(content, 1, WINDOW)
    four = lambda at: _latin(content, at, 4)
    long_ = F.length(content) >= 12
    out = F.when(content.isNull(), F.lit(None).cast("string")).when(F.length(content) == 0, "vacio")
    out = out.when((four(0) == "RIFF") & long_, F.coalesce(mapped(four(8), RIFF), F.lit("riff"))).when(four(0) == "RF64", "wav").when(F.substring(content, 1, 8) == F.lit(WAVE64), "wave64")
    out = out.when((four(0) == "FORM") & long_, F.coalesce(mapped(four(8), FORM), F.lit("iff"))).when((four(4) == "ftyp") & long_, F.coalesce(mapped(four(8), BRANDS), F.lit("isobmff")))
    out = out.when(four(0).isin("PK\x03\x04", "PK\x05\x06", "PK\x07\x08"), zip_type(content)).when(F.substring(content, 1, 8) == F.lit(CFB), "cfb")
    out = out.when(_latin(content, 60, 8).isin(*PALM), mapped(_latin(content, 60, 8), PALM))
    start = F.hex(F.substring(content, 1, 200))
    declared = F.conv(F.concat(*[F.substring(start, i, 2) for i in (11, 9, 7, 5)]), 16, 10).cast("long")
    by_pattern = reduce(lambda w, p: w.when(start.rlike(p[0]), p[1]), PATTERNS, F.when(start.startswith("4D4D") & (F.length(start) >= 12) & (declared == size), "3ds"))
    text = F.decode(window, "ISO-8859-1")
    by_text = F.when(text.rlike(r"(?s)^[\t\n\r\x20-\xFF]*\z"), text_type(text)).otherwise("desconocido")
    return out.otherwise(F.coalesce(by_marks(content), by_pattern.otherwise(by_text)))


def probe_category(kind: Column) -> Column:
    """What probe a type needs; null for types without one."""
    return mapped(kind, {k: c for c, kinds in PROBE.items() for k in kinds})
