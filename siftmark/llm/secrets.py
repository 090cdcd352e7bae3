"""Secret scan: keyword automaton, anchored expressions at its hits, checksum validation.

An Aho-Corasick automaton over the lower-cased text finds every place where a secret's keyword stands; only there
an anchored regular expression is tried. Runs of hexadecimal digits have no keyword and are searched directly.
Tokens that carry a checksum of their own (a CRC-32 in base 62 behind thirty characters) are added only if it holds.
"""

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
# The keywords in lower case and the kind that each announces; digits of base 62.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked"}
KINDS = ("assign", "access", "hex", "checked")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(65, 91)}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out.rjust(width, "0")


def checksum_holds(body: str, check: str) -> bool:
    return base62(zlib.crc32(body.encode())) == check


def _try(kind: str, text: str, at: int) -> tuple[int, bool] | None:
    """Where a match that begins here ends, and whether it counts."""
    if kind == "assign":
        return (m.end(), len(m[2]) >= 12) if (m := ASSIGN.match(text, at)) else None
    if kind == "access":
        return (m.end(), m.end() - at >= 18) if (m := ACCESS.match(text, at)) else None
    return (m.end(), checksum_holds(m[1], m[2])) if (m := CHECKED.match(text, at)) else None


def find(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) in code points, sorted; leftmost and not overlapping within a kind."""
    low = text.lower()
    if len(low) != len(text):  # a letter that grows when lowered would shift what follows
        low = text.translate(_LOWER)
    done, found = dict.fromkeys(KINDS, 0), []
    for at, kind in sorted((end - n + 1, kind) for end, (n, kind) in words.iter(low)):
        if at >= done[kind] and (m := _try(kind, text, at)):
            done[kind] = m[0]
            if m[1]:
                found.append((at, KINDS.index(kind), m[0]))
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = automaton()
    for batch in batches:
        spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t, words)] for t in texts(batch)]
        yield pa.record_batch([batch.column(0), pa.array(spans, SPAN)], names=["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row of docs (doc_id, text): whole texts.

    Offsets count code points, ends are exclusive; spans are sorted by start, then kind in the order of KINDS. Null
    and empty texts have no spans. Repeated rows and rows without doc_id come back as they are. No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_work, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")
