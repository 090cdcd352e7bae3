"""File formats: names, capabilities, what their signatures may be, safe names."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .signatures import MARKS, PATTERNS, mapped

# Aliases of extensions; extensions by capability.
ALIASES = {"jpeg": "jpg", "tiff": "tif", "htm": "html", "markdown": "md"}
CATEGORY = {
    "imagen": ("png", "tif", "tiff", "webp", "avif", "jpg", "jpeg", "gif", "bmp", "ico"),
    "vectorial": ("svg",),
    "documento": ("pdf", "docx", "odt", "tex", "epub", "mobi", "azw3", "html", "md", "txt", "rtf"),
    "hoja": ("xlsx", "ods"),
    "presentacion": ("pptx", "odp"),
    "video": ("mp4", "mkv", "webm", "mov", "avi", "mpd"),
    "audio": ("wav", "flac", "mp3", "m4a", "aac", "opus", "ogg"),
    "datos": ("csv", "json", "tsv"),
}
HOLDS_TEXT = ("svg", "pdf", "docx", "odt", "xlsx", "ods", "pptx", "odp", "tex", "epub", "mobi", "azw3", "html", "md", "txt", "rtf", "csv", "json", "tsv")
HOLDS_ALPHA = ("png", "tif", "tiff", "webp", "avif", "gif", "ico", "svg", "pdf")
DEPTH = {"png": 16, "tif": 16, "tiff": 16, "avif": 12, "pdf": 16}
LOSSY = ("webp", "avif", "jpg", "jpeg", "gif", "mp4", "mkv", "webm", "mov", "avi", "mpd", "mp3", "m4a", "aac", "opus", "ogg")
RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)])
# Types that an extension's file may show. A type's own name is an extension that may show it, if nothing
# is said of it here.
ACCEPTED = {
    "jpg": ("jpeg",), "jpe": ("jpeg",), "jfif": ("jpeg",), "mjpeg": ("jpeg",), "jp2": ("jpeg2000", "mj2", "isobmff"), "j2k": ("jpeg2000", "mj2", "isobmff"), "tif": ("tiff", "bigtiff"), "bigtiff": ("bigtiff", "tiff"),
    "webp": ("webp",), "avif": ("avif", "isobmff"), "heic": ("heif", "isobmff"), "heif": ("heif", "isobmff"), "psb": ("psd",), "ras": ("sunras",), "hdr": ("radiance",), "cin": ("cineon",), "cur": ("cur", "ico"),
    "mpc": ("mpc", "musepack"), "mat": ("mat", "texto"), "cal": ("cals",), "pct": ("pict",), "rb": ("rocketbook",), "pbm": ("pnm",), "pgm": ("pnm",), "ppm": ("pnm",), "brf": ("brf",),
    "mp3": ("mp3", "mpegaudio"), "aac": ("adts",), "eac3": ("ac3",), "opus": ("ogg",), "oga": ("ogg",), "ogv": ("ogg",), "wav": ("wav",), "w64": ("wave64",), "aif": ("aiff",), "aifc": ("aiff",), "snd": ("au",), "wv": ("wavpack",),
    "mid": ("midi",), "m4a": ("m4a", "mp4", "isobmff"), "m4b": ("m4a", "mp4", "isobmff"), "mp4": ("mp4", "mov", "m4a", "isobmff"), "m4v": ("mp4", "mov", "m4a", "isobmff"), "mov": ("mov", "mp4", "isobmff"), "3gp": ("3gp", "mp4", "isobmff"),
    "mkv": ("matroska",), "mka": ("matroska",), "webm": ("matroska",), "avi": ("avi",), "wmv": ("asf",), "wma": ("asf",), "rm": ("realmedia",), "mpg": ("mpegps",), "mpeg": ("mpegps",), "vob": ("mpegps",), "m2v": ("mpegvideo", "flujo_es"),
    "ts": ("mpegts",), "m2ts": ("m2ts", "mpegts"), "h264": ("flujo_es",), "h265": ("flujo_es",), "obu": ("av1obu",), "ps": ("postscript",), "eps": ("postscript", "eps_binario"), "gz": ("gzip",), "bz2": ("bzip2",),
    "zip": ("zip", "docx", "xlsx", "pptx", "odt", "ods", "odp", "odg", "epub"), "epub": ("epub", "zip"), "docx": ("docx", "zip"), "xlsx": ("xlsx", "zip"), "pptx": ("pptx", "zip"), "odt": ("odt", "zip", "xml"), "ods": ("ods", "zip"),
    "odp": ("odp", "zip"), "odg": ("odg", "zip"), "doc": ("cfb",), "xls": ("cfb",), "ppt": ("cfb",), "mobi": ("mobi",), "azw3": ("mobi",), "pdb": ("mobi", "palm_imagen", "ereader"), "svg": ("svg", "xml"), "svgz": ("gzip",),
    "html": ("html", "xml", "texto"), "xhtml": ("html", "xml", "texto"), "xml": ("xml", "svg", "html", "texto"), "fb2": ("xml", "svg", "html", "texto"), "mpd": ("xml", "svg", "html", "texto"), "stl": ("stl_ascii", "stl_binario"), "stp": ("step",),
    "glb": ("glb", "texto"), "gltf": ("glb", "texto"), "fbx": ("fbx", "texto"), "x": ("directx_x",), "fig": ("xfig",), "gpl": ("gimp_paleta",),
    "csv": ("texto",), "json": ("texto",), "yaml": ("texto",), "toml": ("texto",), "srt": ("texto",), "txt": ("texto", "im_texto"), "md": ("texto", "im_texto"), "tsv": ("texto", "im_texto"),
}
# Extensions whose marks show a family only; those whose files have no mark.
FAMILY_ONLY = ("csv", "json", "yaml", "toml", "txt", "md", "tsv", "srt", "xml", "html", "xhtml", "fb2", "gltf", "fbx", "mpd")
NO_MARK = ("rgb", "rgba", "bgr", "cmyk", "gray", "yuv", "g3", "g4", "fax", "group4", "pcm", "al", "ul", "gsm", "avs", "tga", "wbmp", "docbook", "jats", "mediawiki", "tex", "latex", "rst", "org", "textile", "asciidoc", "obj", "pov", "ftxt")
UNNAMED = ("desconocido", "matroska", "realmedia", "jpeg", "jpeg2000", "mpegaudio", "flujo_es", "av1obu", "eps_binario", "stl_binario", "directx_x", "rocketbook", "wave64")  # types that are no extension
for _kind in dict.fromkeys([m.kind for m in MARKS] + [k for _, k in PATTERNS]):
    if _kind not in UNNAMED:
        ACCEPTED.setdefault(_kind, (_kind,))


def spread(groups: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """{member: group} of {group: members}."""
    return {m: g for g, members in groups.items() for m in members}


def extension(name: Column) -> Column:
    """The last extension of a file name, as written, without its dot; empty if it has none."""
    return F.regexp_extract(name, r"[^./\\]\.([^./\\]+)$", 1)


def normal_extension(ext: Column) -> Column:
    """Lower case, leading dots gone, aliases resolved; null counts as empty."""
    low = F.regexp_replace(F.lower(F.coalesce(ext, F.lit(""))), r"^\.+", "")
    return F.coalesce(mapped(low, ALIASES), low)


def formats(spark: SparkSession) -> DataFrame:
    """(ext, categoria, texto, alfa, prof_max, perdida): a small table that joins may broadcast."""
    rows = [(e, c, e in HOLDS_TEXT, e in HOLDS_ALPHA, DEPTH.get(e, 8), e in LOSSY) for e, c in spread(CATEGORY).items()]
    return spark.createDataFrame(rows, "ext string, categoria string, texto boolean, alfa boolean, prof_max int, perdida boolean")


def _le(content: Column, at: int, n: int) -> Column:
    """An unsigned little-endian number of n bytes at an offset."""
    return F.conv(F.concat(*[F.hex(F.substring(content, at + 1 + i, 1)) for i in range(n - 1, -1, -1)]), 16, 10).cast("long")


def _be(content: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, n)), 16, 10).cast("long")


def signature_status(ext: Column) -> Column:
    """How far an extension's signature can be checked: evaluado, familia, no_aplica or sin_vocabulario."""
    known = ext.isin(*ACCEPTED)
    return F.when(known & ext.isin(*FAMILY_ONLY), "familia").when(known, "evaluado").when(ext.isin(*NO_MARK), "no_aplica").otherwise("sin_vocabulario")


def coherent(kind: Column, ext: Column) -> Column:
    """Whether a real type may carry an extension; null where the extension has no known signature."""
    some = F.element_at(F.create_map(*[x for e, kinds in ACCEPTED.items() for x in (F.lit(e), F.array(*map(F.lit, kinds)))]), ext)
    return F.array_contains(some, kind)


def declared_length_status(content: Column, size: Column | None = None, tail: Column | None = None) -> Column:
    """completo or incompleto by what the header declares, sin_declaracion if it declares nothing. Where content is only a
    file's beginning, size is that of the file and tail its end, 8 bytes or more."""
    n, kind = (F.length(content) if size is None else size).cast("long"), F.decode(F.substring(content, 1, 4), "ISO-8859-1")
    tail = content if tail is None else tail
    riff = _le(content, 4, 4)
    riff_says = F.when(riff.isin(0, 0xFFFFFFFF), "sin_declaracion").when(n >= riff + 8, "completo").otherwise("incompleto")
    png = F.when(F.decode(F.substring(tail, -8, 4), "ISO-8859-1") == "IEND", "completo").otherwise("incompleto")
    return F.when(n < 12, "incompleto").when(kind == "RIFF", riff_says).when(F.substring(content, 1, 8) == F.unhex(F.lit("89504e470d0a1a0a")), png).otherwise("sin_declaracion")


def png_megapixels(content: Column) -> Column:
    """Millions of pixels from a PNG's header; null for other files. Two sides of 32 bits may pass a long."""
    side = lambda at: _be(content, at, 4).cast("decimal(10,0)")
    return F.when(F.substring(content, 1, 8) == F.unhex(F.lit("89504e470d0a1a0a")), (side(16) * side(20)).cast("double") / 1e6)


def safe_name(name: Column) -> Column:
    """Whether a name is a plain file name everywhere: no separators, streams, trailing dots or spaces, no device."""
    device = F.upper(F.substring_index(name, ".", 1)).isin(*RESERVED)
    return F.coalesce((name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\:]") & ~name.rlike(r"[. ]\z") & ~device, F.lit(False))
