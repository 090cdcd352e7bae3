"""Texts: normalisations, counts, token signals, error rates."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to; punctuation that the census counts.
ACCENTED, PLAIN = "áéíóúüñàèìòùâêîôûäëïöç", "aeiouunaeiouaeiouaeioc"
PUNCTUATION = ".,;:!?"


def normal(text: Column, fold: bool = False, keep_punctuation: bool = False) -> Column:
    """Lower case, single spaces; accents folded or kept, what isn't a letter or digit dropped or kept."""
    low = F.lower(text)
    if fold:
        low = F.translate(low, ACCENTED, PLAIN)
    if keep_punctuation:
        return F.trim(F.regexp_replace(low, "[ \\t\\r\\n]+", " "))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+" if fold else f"[^a-z0-9{ACCENTED}]+", " "))


# What each byte of UTF-8 is in a folded text; and the letter of a byte that follows the first one of U+00C0 to U+00FF.
_BYTES = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_LATIN = np.zeros(256, np.uint8)
for _a, _p in zip(ACCENTED, PLAIN):
    _LATIN[[_a.encode()[1], _a.upper().encode()[1]]] = ord(_p)
_FIRST_LATIN = "é".encode()[0]
_RARE = {"\u0130".encode(): b"i ", "\u212a".encode(): b"kkk"}  # the other letters whose lower case is of a to z: a dotted I (and its dot), the Kelvin sign


def normal_bytes(texts: pa.Array, most: int = 1 << 20) -> list[bytes | None]:
    """normal(fold=True) of an array of strings in a task, by bytes, some `most` of them at once."""
    n = len(texts)
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, wide, n + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out: list[bytes | None] = []
    while len(out) < n:
        i = len(out)
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        out += _folded(raw[at[i] : at[j]], at[i : j + 1] - at[i])
    return out if not texts.null_count else [x if there else None for x, there in zip(out, texts.is_valid().to_pylist())]


def _folded(raw: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The texts between the places `at` of UTF-8."""
    x, stays = _BYTES[raw], np.ones(len(raw), bool)
    if len(raw) and raw.max() > 127:
        two = np.flatnonzero(raw[:-1] == _FIRST_LATIN)
        two = two[_LATIN[raw[two + 1]] > 0]
        x[two] = x[two + 1] = _LATIN[raw[two + 1]]
        stays[two + 1] = False
        for rare, read in _RARE.items():
            first = np.flatnonzero(raw[: 1 - len(rare)] == rare[0])
            for k in range(1, len(rare)):
                first = first[raw[first + k] == rare[k]]
            for k, c in enumerate(read):
                x[first + k] = c
                stays[first + k] = k == 0 or c == 32
    blank = x == 32
    before = np.append(True, blank[:-1]) if len(raw) else blank
    before[at[:-1][at[:-1] < len(raw)]] = True
    stays &= ~(blank & before)
    upto = np.append(0, np.cumsum(stays))[at]
    text = x[stays].tobytes()
    return [text[i:j].rstrip(b" ") for i, j in zip(upto[:-1].tolist(), upto[1:].tolist())]


def count_of(text: Column, characters: str) -> Column:
    """How many of the characters stand in the text."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("int")


BLANK = " \\t\\r\\n"


def _words_of(text: Column, letters: str) -> Column:
    """How many words between blanks consist of the given class of characters alone."""
    return F.regexp_count(text, F.lit(f"(?<![^{BLANK}]){letters}(?![^{BLANK}])"))


def token_signals(text: Column) -> dict[str, Column]:
    """tokens between blanks, their mean length, and the percentages that are a single character, have no letter, or no vowel;
    0 of none. Counted on the whole text: no array of words is made. sospecha: short words throughout, a warning and not a
    verdict; fewer than eight words aren't judged."""
    n = F.regexp_count(text, F.lit(f"[^{BLANK}]+"))
    share = lambda k: F.when(n > 0, 100.0 * k / n).otherwise(0.0)
    mean = F.when(n > 0, F.length(F.regexp_replace(text, f"[{BLANK}]+", "")) / n).otherwise(0.0)
    one = share(_words_of(text, f"[^{BLANK}]"))
    return {
        "tokens": n, "media": mean, "una": one, "no_alfa": share(_words_of(text, f"[^{BLANK}a-zA-Z]+")), "sin_vocal": share(_words_of(F.lower(text), f"[^{BLANK}aeiou]+")),
        "sospecha": (n >= 8) & ((mean < 3.0) | (one >= 50.0)),
    }


def error_rate(ref: Column, out: Column) -> Column:
    """Character error rate in percent of the reference's length: it may pass 100; null for an empty reference. An output that stands in
    the reference as it is lacks the rest of it and nothing else: no matrix is made."""
    distance = F.when(F.contains(ref, out), F.length(ref) - F.length(out)).otherwise(F.levenshtein(ref, out))
    return F.when(F.length(ref) > 0, 100.0 * distance / F.length(ref))


def collapse_class(cer: Column, size: Column, ref_size: Column) -> Column:
    """How an output collapsed, from its size and error rate."""
    return F.when(size == 0, "SILENCIO").when((size <= 25) & (cer >= 90), "ATOMICA").when((size > 1.3 * ref_size) & (cer > 50), "ALUCINACION").otherwise("normal")


def lines_of(text: Column) -> Column:
    """Physical lines: line feeds, and one more if the last line has none."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(n + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value. Spark's parser passes over what follows a value, so it is asked about the text as the
    only member of an array and of an object: what closes either too early leaves the other open."""
    listed, held = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return held.isNotNull() & listed.isNotNull() & F.try_variant_get(F.coalesce(listed, F.parse_json(F.lit("[]"))), "$[1]", "variant").isNull()


def data_facts(content: Column, kind: Column) -> Column:
    """What the bytes of a data file show: struct(utf8_valido, reemplazo, json_valido, anchos, bom). json_valido is null but for
    json, anchos (the different numbers of fields of its lines, blank ones apart) but for csv."""
    text = content.cast("string")
    valid = F.is_valid_utf8(text)
    read = F.make_valid_utf8(text)
    lines = F.filter(F.split(F.regexp_replace(read, "\r\n", "\n"), "\n"), lambda x: F.trim(x) != "")
    bom = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    bare = F.when(bom, F.substring(read, 2, 1 << 30)).otherwise(read)
    return F.struct(
        valid.alias("utf8_valido"), (valid & F.contains(read, F.lit("\uFFFD"))).alias("reemplazo"), F.when(kind == "json", is_json(bare)).alias("json_valido"),
        F.when(kind == "csv", F.array_sort(F.array_distinct(F.transform(lines, lambda x: F.size(F.split(x, ",", -1)))))).alias("anchos"), bom.alias("bom"),
    )
