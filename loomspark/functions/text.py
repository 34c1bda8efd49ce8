"""Column functions over text: trimming, page signals, hashes, keys, query clean-up and names. All JVM-side but simhash."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.operators.shared import NUMBERS, runs_within

SPACE = r"[\s\x{FEFF}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CONTROL = r"[\x00-\x08\x0E-\x1F\x7F-\x9F\p{Cf}\p{Co}\x{FFFD}]"
#: Letters of the scripts that a page is expected to be in.
READABLE = r"[A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}\x{370}-\x{3FF}\x{400}-\x{4FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"


#: The same characters, for a trim that looks at the ends alone.
BLANKS = " \t\n\x0b\f\r\ufeff\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """Tokens between white space, in order, repeats included."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


_SPACES = re.compile("[" + re.escape(BLANKS) + "]+")


def word_list(text: str | None) -> list[str]:
    """Lower-cased words between white space, in Python."""
    return [w for w in _SPACES.split(text.lower()) if w] if text else []


def word_set(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def terms(c: Column) -> Column:
    """What keyword search indexes: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


_TERM = re.compile(r"[^\W_]+")


def term_list(text: str | None) -> list[str]:
    """The same in Python, for scans that hold a batch of queries."""
    return _TERM.findall(text.lower()) if text else []


def _members(c: Column, others: str) -> Column:
    """How many characters stay when runs of others are taken out: no match, and no string, for each of them."""
    return F.length(F.regexp_replace(c, others, ""))


def ctrl_ratio(c: Column) -> Column:
    return F.coalesce(F.try_divide(_members(c, f"[^{CONTROL[1:]}+"), F.length(c)), F.lit(0.0))


def valid_frac(c: Column, readable: str = READABLE) -> Column:
    return F.coalesce(F.try_divide(_members(c, f"[^{readable[1:]}+"), _members(c, r"\P{L}+")), F.lit(1.0))


_CONTROL, _LETTER, _READABLE = 1, 2, 4
_SPANS = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x370, 0x3FF), (0x400, 0x4FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF))
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """What each code point counts as, made once a worker."""
    if not _KINDS:
        table = np.zeros(0x110000, np.uint8)
        for i in (*range(0x33000), *range(0xE0000, 0xE1000)):
            kind = unicodedata.category(chr(i))
            table[i] = _LETTER if kind[0] == "L" else _CONTROL if kind in ("Cf", "Co") else 0
        table[0xE000:0xF900] = table[0xF0000:0xFFFFE] = table[0x100000:0x10FFFE] = _CONTROL
        for a, b in ((0, 8), (0x0E, 0x1F), (0x7F, 0x9F), (0xFFFD, 0xFFFD)):
            table[a : b + 1] |= _CONTROL
        for a, b in _SPANS:
            table[a : b + 1] |= _READABLE
        _KINDS.append(table)
    return _KINDS[0]


def page_counts(c: Column) -> Column:
    """(size, control, letters, readable) of the trimmed text, by one table of the code points: what ctrl_ratio and
    valid_frac come from, many times faster than by patterns of that many ranges."""

    @F.pandas_udf("size int, control int, letters int, readable int")
    def run(texts: pd.Series) -> pd.DataFrame:
        return count_kinds(texts)

    return run(c)


def count_kinds(texts: pd.Series) -> pd.DataFrame:
    """What page_counts gives, of many short texts or of a part of a long one at once."""
    kept = [t.strip(BLANKS) if t else "" for t in texts]
    part = [(i, t[at : at + NUMBERS]) for i, t in enumerate(kept) for at in range(0, len(t), NUMBERS)]
    size = np.array([len(t) for _, t in part], np.int64)
    found = np.zeros((3, len(kept)), np.int64)
    for a, b in runs_within(size, NUMBERS):
        kinds = _kinds()[np.frombuffer("".join(t for _, t in part[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.cumsum(size[a:b]) - size[a:b]
        for k, bit in enumerate((_CONTROL, _LETTER, _READABLE)):
            np.add.at(found[k], [i for i, _ in part[a:b]], np.add.reduceat(kinds & bit > 0, first, dtype=np.int64))
    return pd.DataFrame({"size": [len(t) for t in kept], "control": found[0], "letters": found[1], "readable": found[2]})


def route_page(text: Column, graphics: Column, mojibake: Column, *, least: int = 200, ctrl: float = 0.002, valid: float = 0.6, moji: float = 0.001) -> Column:
    """'fast' for a readable page, else 'mineru' where it has graphics, else 'vlm'. A null text counts as empty."""
    t = js_trim(F.coalesce(text, F.lit("")))
    return route_of(F.length(t), ctrl_ratio(t), valid_frac(t), graphics, mojibake, least=least, ctrl=ctrl, valid=valid, moji=moji)


def route_of(size: Column, control: Column, readable: Column, graphics: Column, mojibake: Column, *, least: int = 200, ctrl: float = 0.002, valid: float = 0.6, moji: float = 0.001) -> Column:
    """The same from signals that are columns already, so that a page's text is looked through once."""
    garbled = (size < least) | (control > ctrl) | (readable < valid) | (F.coalesce(mojibake, F.lit(0.0)) > moji)
    return F.when(garbled, F.when(F.coalesce(graphics, F.lit(False)), "mineru").otherwise("vlm")).otherwise("fast")


def page_badness(text: Column) -> Column:
    """The share of characters that betray a wrong decoding: replacement characters, and Latin letters of a two-byte UTF-8
    sequence read one by one. 0 for a null or empty text."""
    bad = F.regexp_count(text, F.lit(r"\x{FFFD}|[\x{C2}\x{C3}\x{C5}\x{D0}\x{D1}][\x{80}-\x{BF}]"))
    return F.coalesce(F.try_divide(bad, F.length(text)), F.lit(0.0))


def without_mineru(route: Column) -> Column:
    return F.when(route == "mineru", "vlm").otherwise(route)


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def stage_key(stage: Column, version: Column, config_json: Column, parents: Column) -> Column:
    """config_json is the key-sorted JSON of the stage's settings."""
    return short_hash(F.concat_ws("|", stage, version, config_json, F.array_join(F.array_sort(parents), ",")))


def embed_row_key(provider: Column, model: Column, version: Column, text: Column) -> Column:
    return short_hash(F.concat_ws("|", F.lit("embed"), provider, model, version, short_hash(text)))


def vec_field(model: Column) -> Column:
    return F.concat(F.lit("vec_"), F.substring(F.sha2(model, 256), 1, 16))


def stub_embedding(c: Column) -> Column:
    """Eight numbers that follow from the length alone; for tests."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.length(c) + i) % 7) / F.lit(7.0))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty or null vectors, of different length, or of norm 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


#: Digests of words that a worker has met, of so many at most that they fit.
_DIGESTS: dict[str, bytes] = {}


def simhash_value(text: str | None) -> int | None:
    """64 votes of md5 prefixes, one for each occurrence of a word; signed. 0 for a text without words."""
    if text is None:
        return None
    tokens = text.lower().split()
    if not tokens:
        return 0
    known = Counter(tokens)
    if len(_DIGESTS) > 1 << 18:
        _DIGESTS.clear()
    found = []
    for t in known:
        if (h := _DIGESTS.get(t)) is None:
            h = _DIGESTS[t] = hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()[:8]
        found.append(h)
    bits = np.unpackbits(np.frombuffer(b"".join(found), np.uint8).reshape(-1, 8), axis=1)
    votes = 2 * (np.array(list(known.values()), np.float64) @ bits.astype(np.float64)) - len(tokens)
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big", signed=True)


def simhash(c: Column) -> Column:
    """A map over rows, without the shuffle that counting votes by document would need."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash_value(t) for t in texts], dtype="Int64")

    return run(c)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def contained_in(small: Column, large: Column) -> Column:
    """Share of the first word set that the second has; 0 for an empty one."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(small, large)), F.size(small)), F.lit(0.0))


# ---------------------------------------------------------------- names and formats

SHEETS, LEGACY, TEXTS, IMAGES, OFFICE, SOFFICE = ("csv", "xlsx"), ("xls", "ods"), ("txt", "md", "markdown", "text", "log"), ("png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp", "gif"), ("docx", "pptx", "html", "htm"), ("odt", "odp", "rtf", "doc", "ppt")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.\\/]+)$", 1))


def route_format(name: Column) -> Column:
    """Which parser a file goes to; 'pdf' where no other claims it."""
    e = extension(name)
    routes = (("legacy_sheet", LEGACY), ("sheet", SHEETS), ("text", TEXTS), ("image", IMAGES), ("soffice", SOFFICE), ("office", OFFICE))
    out = F.lit("pdf")
    for route, known in reversed(routes):
        out = F.when(e.isin(*known), route).otherwise(out)
    return out


_MIME = {
    "csv": "text/csv", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xls": "application/vnd.ms-excel", "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "doc": "application/msword", "ppt": "application/vnd.ms-powerpoint", "odt": "application/vnd.oasis.opendocument.text", "odp": "application/vnd.oasis.opendocument.presentation", "rtf": "application/rtf",
}


def is_presentation(name: Column) -> Column:
    return extension(name).isin("pptx", "ppt", "odp")


def accepted(name: Column) -> Column:
    """Whether a file of that name is taken at all."""
    return extension(name).isin("pdf", *SHEETS, *LEGACY, *TEXTS, *IMAGES, *OFFICE, *SOFFICE)


def content_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in _MIME.items() for x in pair])
    return F.coalesce(F.get(F.array(F.try_element_at(known, extension(name))), F.lit(0)), F.lit("application/pdf"))


# ---------------------------------------------------------------- model output


def clean_query(raw: Column, cap: int = 60) -> Column:
    """The rewritten query in a model's reply: no thinking, no label, the first line that isn't a heading, cap words."""
    bare = F.regexp_replace(raw, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    lines = F.transform(F.split(bare, "\n"), lambda s: js_trim(F.regexp_replace(js_trim(s), r"(?i)^(?:standalone query|rewritten query|query)\s*:\s*", "")))
    some = F.filter(lines, lambda s: s != "")
    body = F.coalesce(F.get(F.filter(some, lambda s: ~s.endswith(":")), F.lit(0)), F.get(some, F.lit(0)), raw)
    return F.array_join(F.slice(words(body), 1, cap), " ")


def parse_query_list(raw: Column, fallback: Column) -> Column:
    """Queries of a reply that is a JSON array, of which strings count, fenced or not, or a list of lines; [fallback]
    where there is none."""
    bare = js_trim(F.regexp_replace(js_trim(F.coalesce(raw, F.lit(""))), r"^```(?:json)?|```$", ""))
    tidy = lambda items: F.filter(F.transform(items, js_trim), lambda s: s.isNotNull() & (s != ""))
    items = F.try_variant_get(F.try_parse_json(bare), "$", "array<variant>")
    strings = tidy(F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string")))
    lines = tidy(F.transform(F.split(bare, "\n"), lambda s: F.regexp_replace(js_trim(s), r"^(?:[-*]|\d+[.)])\s*", "")))
    found = F.when(bare.startswith("["), F.coalesce(strings, lines)).otherwise(lines)
    return F.when(F.size(found) > 0, found).otherwise(F.array(fallback))


def normalize_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s_]+", " "), r"\s+", " "))


# ---------------------------------------------------------------- colours

SWATCHES = {"red": (220, 60, 60), "orange": (235, 150, 70), "yellow": (240, 235, 120), "green": (130, 220, 150), "blue": (150, 160, 235), "purple": (170, 110, 200), "pink": (240, 150, 200)}


def is_saturated(r: Column, g: Column, b: Column, least: int = 28) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b) >= least


def color_name(r: Column, g: Column, b: Column) -> Column:
    """The nearest swatch of a saturated colour, null of a grey one."""
    near = F.array_min(F.array(*[F.struct((F.pow(r - x, 2) + F.pow(g - y, 2) + F.pow(b - z, 2)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, (x, y, z)) in enumerate(SWATCHES.items())]))
    return F.when(is_saturated(r, g, b), near["name"])
