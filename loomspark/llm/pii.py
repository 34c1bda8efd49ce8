"""Personal data: detected entities get keyed surrogates of the same type and shape, the same one wherever the entity
occurs and never one that another entity has or is.

A surrogate comes from a keyed permutation (a Feistel network with cycle walking) of all values of the entity's shape,
so distinct entities of a shape can't meet. What a permutation alone can't exclude, that the surrogate is itself a real
entity of the corpus (or the same as before) or that surrogates of different shapes or attempts meet, is checked over
all entities of the corpus: whoever collides tries again with the next tweak, until none does.

A name is replaced word by word, the given name within its script and gender, each surname by itself: 'Mr Silva' and
'Ana Silva' go on sharing theirs. A surname that a text has with a title or a known given name is found wherever else
that text has it."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, short_batches, spread, table
from .names import ENDINGS, GIVEN, LETTERS, OPENERS, TITLES, VOWELS

TYPES = ("email", "phone", "ip", "ip6", "card", "ssn", "iban", "birth", "secret", "name")
_GIVEN_OF = {n: (script, gender) for (script, gender), pool in GIVEN.items() for n in pool}
_CAP = "[^\\W\\d_]"
_UP = "[A-ZÀ-ÖØ-ÞĀ-ſΆ-ΫЀ-Я]"
_NAME = (
    r"(?P<name>\b(?:(?:" + "|".join(TITLES) + r")\b\.?[ \t]+(?:" + _UP + _CAP + r"+(?:-" + _UP + _CAP + r"+)?[ \t]+)?|(?:" + "|".join(sorted(_GIVEN_OF, key=len, reverse=True)) + r")[ \t]+)" + _UP + _CAP + r"+(?:-" + _UP + _CAP + r"+)?\b)"
)
#: One alternative for each way an entity may begin; digits and @ are rare, so most positions fail on their first character.
_SHAPES = re.compile(
    r"(?P<secret>(?<![\w])(?:token|password|passwd|secret|api_?key)\s*[=:]\s*\"?[\w+/-]{8,}={0,2}\"?|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_\w{36,}|\bsk-[\w-]{20,})"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w])|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\w|\.\d))"
    r"|(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w))",
    re.IGNORECASE,
)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
#: A date counts as personal where it is said to be one of birth.
_BIRTH = re.compile(
    r"(?<!\w)(?:born(?:[ \t]+on)?|date[ \t]+of[ \t]+birth|birth[ \t]?date|dob|d\.o\.b\.|geboren(?:[ \t]+am)?|geburtsdatum|née?[ \t]+le|date[ \t]+de[ \t]+naissance|nacid[oa](?:[ \t]+el)?|fecha[ \t]+de[ \t]+nacimiento|дата[ \t]+рождения|родил(?:ся|ась))"
    r"[ \t]*[:=]?[ \t]*(?P<birth>\d{4}-\d{1,2}-\d{1,2}|\d{1,2}(?P<s>[./-])\d{1,2}(?P=s)\d{4})(?!\d)",
    re.IGNORECASE,
)
_DOMAIN = re.compile(r"[^\W_](?:[\w-]*\w)?(?:\.[^\W_](?:[\w-]*\w)?)+")
_NAMES = re.compile(_NAME)
#: A capitalised word before another: only where it is a title or a known given name is the whole pattern tried.
_CAPITALISED = re.compile(_UP + r"[^\W\d_]+(?=\.?[ \t]+" + _UP + ")")
_WORD = re.compile(_UP + r"[^\W\d_]{2,}")
#: Two capitalised words of which the second ends as surnames do.
_ENDED = re.compile(r"\b" + _UP + r"[^\W\d_]{2,}[ \t]+" + _UP + r"[^\W\d_]{2,}(?:" + "|".join(ENDINGS) + r")\b")
_STARTS = frozenset([*TITLES, *_GIVEN_OF])
_LOW_TITLES = tuple(t for t in TITLES if t[0].islower())
_DIGIT = re.compile(r"\d")
_SECRET_HEAD = re.compile(r"(\w+\s*[=:]\s*\"?|AKIA|ASIA|gh[pousr]_|sk-)", re.IGNORECASE)


#: Beyond this attempt surrogates come from a wider range, as so many short entities may exist that their shape has no
#: value left that none of them has: emails, secrets, bank accounts and surnames grow by a character each time, a given
#: name alone gets a growing surname, a private address may lie in any private network, phones and cards keep no leading
#: digits, and social security numbers may have areas that aren't given out.
WIDEN_AFTER = 5


@dataclass(frozen=True)
class PiiParams:
    key: str = "loomspark-demo-key"  # a deployment passes its own
    #: Rounds that may leave no fewer collisions than before; after that it is an error. Rounds that help aren't counted.
    attempts: int = 16


# ---------------------------------------------------------------- detection


def find_entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of every entity of the whole text, in order and not overlapping; [] for a null text."""
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > 0 and _in_local(text[start - 1]):
                start -= 1
            while start < at and text[start] in ".+%-":
                start += 1
            if start < at and text[domain.start() : domain.end()].rpartition(".")[2].isalpha():
                spans.append((start, domain.end(), "email"))
        at = text.find("@", at + 1)
    digits = _DIGIT.search(text) is not None
    if digits or "=" in text or ":" in text:
        spans += [(*m.span(), m.lastgroup or "") for m in _SHAPES.finditer(text)]
    if digits:
        spans += [(*m.span("birth"), "birth") for m in _BIRTH.finditer(text) if _date(m["birth"])]
        spans += [(*m.span(), "iban") for m in _IBAN.finditer(text) if _iban_valid(m[0].replace(" ", ""))]
    if "::" in text or text.count(":") > 4:
        spans += [(*m.span(), "ip6") for m in _IP6.finditer(text) if _ip6(m[0])]
    spans += _names(text)
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _in_local(ch: str) -> bool:
    return ch.isalnum() or ch in "._+%-" or unicodedata.category(ch)[0] == "M"


def _names(text: str) -> list[tuple[int, int, str]]:
    """Names with a title, a known given name or the ending of a surname, and wherever else the text has their surnames."""
    starts = [m.start() for m in _CAPITALISED.finditer(text) if m[0] in _STARTS]
    starts += [m.start() for t in _LOW_TITLES if t in text for m in re.finditer(t, text)]
    spans = [m.span() for at in sorted(starts) if (m := _NAMES.match(text, at))]
    spans += [m.span() for m in _ENDED.finditer(text) if m[0].split()[0] not in OPENERS]
    if not spans:
        return []
    known = {w for a, b in spans for w in _name_parts(text[a:b])[1][-1:] if len(w) > 2 and w not in OPENERS}
    last = None
    for m in _WORD.finditer(text):
        if m[0] in known:
            start = m.start()
            before = last is not None and text[last.end() : start].strip(" \t") == "" and last.end() < start
            if before and last[0] not in OPENERS and last[0] not in known:
                start = last.start()
            spans.append((start, m.end()))
        last = m
    return [(a, b, "name") for a, b in spans]


def _date(value: str) -> tuple[datetime.date, str] | None:
    """The date and its layout (year, month, day as y, m, d): day before month unless only the other way is a date."""
    parts = re.split(r"[./-]", value)
    for layout in ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy"):
        of = dict(zip(layout, map(int, parts)))
        try:
            d = datetime.date(of["y"], of["m"], of["d"])
        except ValueError:
            continue
        if FIRST_DAY <= d < LAST_DAY:
            return d, layout
    return None


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2026, 1, 1)


def _iban_rest(body: str, country: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban_valid(value: str) -> bool:
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _ip6(value: str) -> ipaddress.IPv6Address | None:
    try:
        return ipaddress.IPv6Address(value) if len(value) > 4 else None
    except ValueError:
        return None


def canonical(value: str, kind: str) -> str:
    """What mentions of one entity have in common: case of addresses and names, separators of numbers don't count."""
    if kind == "email":
        return value.lower()
    if kind in ("phone", "card"):
        return ("+" if value[0] == "+" else "") + re.sub(r"\D", "", value)
    if kind == "ssn":
        return value.replace("-", "")
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip6":
        return str(ipaddress.IPv6Address(value))
    if kind == "birth":
        d = _date(value)
        return d[0].isoformat() if d else value
    if kind == "secret":
        return _secret_parts(value)[1]
    if kind == "name":
        return " ".join(_name_parts(value)[1])
    return value


def atoms(value: str, kind: str) -> list[tuple[str, str]]:
    """(kind, canonical value) of what gets a surrogate of its own in a mention: of a name each word that isn't a known
    given name before others, as 'surname'; a given name alone is a 'name'."""
    if kind != "name":
        return [(kind, canonical(value, kind))]
    words = _name_parts(value)[1]
    if len(words) == 1 and words[0] in _GIVEN_OF:
        return [("name", words[0])]
    return [("surname", w) for i, w in enumerate(words) if i or w not in _GIVEN_OF]


def _secret_parts(value: str) -> tuple[str, str, str]:
    head = _SECRET_HEAD.match(value)
    start = head.end() if head else 0
    end = len(value) - (value.endswith('"'))
    return value[:start], value[start:end], value[end:]


def _name_parts(value: str) -> tuple[str, list[str]]:
    """(title with its space, words of the name)."""
    m = re.match(r"((?:" + "|".join(TITLES) + r")\b\.?[ \t]+)?(.*)", value, re.S)
    return m[1] or "", m[2].split()


# ---------------------------------------------------------------- keyed permutations


def permute(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed bijection of range(size): four Feistel rounds over the next even number of bits, walked until inside."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        a, b = x >> half, x & mask
        for r in range(4):
            f = hashlib.blake2b(b.to_bytes(width, "big") + bytes([r]) + tweak.encode(), key=key, digest_size=min(64, width)).digest()
            a, b = b, a ^ (_stretch(f, width) & mask)
        x = (a << half) | b
        if x < size:
            return x


def _stretch(f: bytes, width: int) -> int:
    while len(f) < width:
        f += hashlib.blake2b(f).digest()
    return int.from_bytes(f[:width], "big")


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Usual letters of blocks that hold many rare ones.
_COMMON = tuple(x for c in ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý") for x in (c, c.upper()))


@cache
def _class(ch: str, classes: tuple[str, ...]) -> str:
    """The characters that may stand where ch does: one of the given classes, else the digits of its script, or the
    letters of its block and case; '' for a sign, which stays."""
    for c in classes:
        if ch in c:
            return c
    if ch.isdecimal():
        zero = ord(ch) - unicodedata.decimal(ch)
        return "".join(map(chr, range(zero, zero + 10)))
    if not ch.isalpha():
        return ""
    if ch.isascii():
        return _UPPER if ch.isupper() else _LOWER
    for c in _COMMON:
        if ch in c:
            return c
    block = map(chr, range(max(128, ord(ch) & ~0xFF), (ord(ch) | 0xFF) + 1))
    side = (ch.isupper(), ch == ch.lower())
    return "".join(c for c in block if c.isalpha() and (c.isupper(), c == c.lower()) == side)


def _by_class(key: bytes, tweak: str, text: str, classes: tuple[str, ...]) -> str:
    """Permute the strings that have, in each place, a character of the same class; signs stay as they are."""
    radix = [_class(ch, classes) for ch in text]
    shape = "".join(c[0] if c else ch for c, ch in zip(radix, text))
    size, x = 1, 0
    for c, ch in zip(radix, text):
        if c:
            size, x = size * len(c), x * len(c) + c.index(ch)
    x = permute(key, f"{tweak}|{shape}", x, size)
    out = []
    for c, ch in zip(reversed(radix), reversed(text)):
        if c:
            x, k = divmod(x, len(c))
            ch = c[k]
        out.append(ch)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def surrogate(kind: str, value: str, key: str, attempt: int = 0) -> str:
    """The replacement of a canonical value: same type, length and characters' classes; a card stays valid or invalid
    and keeps its first digit, an address its kind of network, a phone its country code, a name its gender and script."""
    k = hashlib.blake2b(key.encode(), digest_size=32).digest()
    tweak = f"{kind}|{attempt}"
    more = max(0, attempt - WIDEN_AFTER)
    if kind == "email":
        local, _, domain = value.partition("@")
        local += "x" * more
        body, _, top = domain.rpartition(".")
        own = (_DIGITS, _LOWER)
        return f"{_by_class(k, tweak, local, own)}@{_by_class(k, 'domain', body, own)}.{top}"
    if kind == "phone":
        fixed = int(value[0] == "+") if more else len(value) - 10 if len(value) > 10 else min(3, len(value) // 3)
        rest, size = value[fixed:], 10 ** (len(value) - fixed)
        plain = lambda s: len(s) != 10 or (s[0] in "23456789" and s[3] in "23456789")
        return value[:fixed] + _walk(k, tweak + value[:fixed], rest, size, plain)
    if kind == "card":
        good = luhn(value)
        head = "" if more else value[0]
        rest = value[len(head) :]
        return head + _walk(k, tweak + head + str(good), rest, 10 ** len(rest), lambda s: luhn(head + s) == good)
    if kind == "ip":
        octets = [int(p) for p in value.split(".")]
        kept = 1 if octets[0] in (10, 127) else 2 if octets[:2] == [192, 168] or (octets[0] == 172 and 16 <= octets[1] < 32) else 0
        if more and kept and octets[0] != 127:
            return _private(permute(k, tweak, _place(octets), sum(n for _, n in PRIVATE)))
        n = int.from_bytes(bytes(octets[kept:]), "big")
        private = lambda o: o[0] in (0, 10, 127) or o[0] >= 224 or o[:2] == [192, 168] or (o[0] == 172 and 16 <= o[1] < 32)
        same = private(octets)
        while True:
            n = permute(k, tweak + str(octets[:kept]), n, 256 ** (4 - kept))
            out = octets[:kept] + list(n.to_bytes(4 - kept, "big"))
            if kept or private(out) == same:
                return ".".join(map(str, out))
    if kind == "ssn":
        given_out = lambda s: s[:3] not in ("000", "666") and (more or s[0] != "9") and s[3:5] != "00" and s[5:] != "0000"
        return _walk(k, tweak + str(more > 0), value, 10**9, given_out)
    if kind == "iban":
        body = _by_class(k, tweak, value[4:] + "0" * more, (_DIGITS, _UPPER))
        return f"{value[:2]}{98 - _iban_rest(body, value[:2]):02d}{body}"
    if kind == "ip6":
        n = int(ipaddress.IPv6Address(value))
        kept = n >> 112
        return str(ipaddress.IPv6Address(kept << 112 | permute(k, f"{tweak}|{kept}", n & ((1 << 112) - 1), 1 << 112)))
    if kind == "birth":
        n = permute(k, tweak, (datetime.date.fromisoformat(value) - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days)
        return (FIRST_DAY + datetime.timedelta(n)).isoformat()
    if kind == "secret":
        value += "0" * more
        hexed = re.fullmatch(r"[0-9a-f]+", value)
        return _by_class(k, tweak, value, ("0123456789abcdef",) if hexed else (_DIGITS, _LOWER, _UPPER))
    if kind == "surname":
        return _surname(k, tweak, value, _script(value), more)
    words = value.split()
    script, gender = _GIVEN_OF.get(words[0], (_script(words[0]), ""))
    if more and gender and len(words) == 1:
        words.append("".join(LETTERS[script][(i + 1) % 2][0] for i in range(more + 2)))
        more = 0
    out = []
    for i, word in enumerate(words):
        if i == 0 and gender:
            pool = GIVEN[script, gender]
            out.append(pool[permute(k, f"given|{script}|{gender}|{attempt}", pool.index(word), len(pool))])
        else:
            out.append(_surname(k, tweak, word, script, more if i == len(words) - 1 else 0))
    return " ".join(out)


#: First address and size of the private networks.
PRIVATE = ((10 << 24, 1 << 24), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16))


def _place(octets: list[int]) -> int:
    """The place of a private address among all of them."""
    n, before = int.from_bytes(bytes(octets), "big"), 0
    for first, size in PRIVATE:
        if first <= n < first + size:
            return before + n - first
        before += size
    raise ValueError(f"{octets} isn't private")


def _private(place: int) -> str:
    for first, size in PRIVATE:
        if place < size:
            return ".".join(map(str, (first + place).to_bytes(4, "big")))
        place -= size
    raise ValueError("there are no more private addresses")


def _walk(key: bytes, tweak: str, digits: str, size: int, wanted) -> str:
    """Cycle walking inside the wanted subset, of which digits may be an unwanted member: then the whole set counts."""
    inside = wanted(digits)
    x = int(digits)
    while True:
        x = permute(key, tweak, x, size)
        s = str(x).zfill(len(digits))
        if wanted(s) == inside:
            return s


def _script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def _surname(key: bytes, tweak: str, word: str, script: str, more: int = 0) -> str:
    """Vowels go to vowels and consonants to consonants of the script, and an ending that tells a surname's gender stays,
    as does a last a; accented letters are part of the tweak. more: letters by which it grows."""
    vowels, consonants = LETTERS[script]
    low = word.lower()
    end = next((e for e in ENDINGS if low.endswith(e) and len(low) > len(e) + 1), low[-1] if low[-1] in "aа" and len(low) > 2 else "")
    low = low[: len(low) - len(end)] + "".join(LETTERS[script][i % 2][0] for i in range(more))
    plain = "".join(ch if ch in vowels + consonants else (vowels[0] if ch in VOWELS[script] else consonants[0] if ch.isalpha() else ch) for ch in low)
    odd = "" if plain == low else low
    new = _by_class(key, f"{tweak}|{script}|{odd}|{end}", plain, (vowels, consonants)) + end
    return "-".join(p[:1].upper() + p[1:] for p in new.split("-"))


def _dress(kind: str, original: str, new: str) -> str:
    """Give a canonical surrogate the separators, title and case of this mention."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(re.sub(r"\D", "", new))
        return "".join(next(digits) if ch.isdigit() else ch for ch in original)
    if kind == "email" and original != original.lower():
        return new.upper() if original == original.upper() else "".join(n.upper() if o.isupper() else n for o, n in zip(original, new)) + new[len(original) :]
    if kind == "secret":
        head, _, tail = _secret_parts(original)
        return head + new + tail
    if kind == "iban" and " " in original:
        return " ".join(new[i : i + 4] for i in range(0, len(new), 4))
    if kind == "ip6" and original != original.lower():
        return new.upper()
    if kind == "birth":
        layout = _date(original)[1]  # type: ignore[index]
        of = dict(zip("ymd", new.split("-")))
        parts = re.split(r"([./-])", original)
        return "".join(p if i % 2 else of[layout[i // 2]] if len(p) > 1 or layout[i // 2] == "y" else str(int(of[layout[i // 2]])) for i, p in enumerate(parts))
    return new


def _new_mention(original: str, kind: str, key: str, retried: dict[tuple[str, str], int]) -> str:
    if kind != "name":
        value = canonical(original, kind)
        return _dress(kind, original, surrogate(kind, value, key, retried.get((kind, value), 0)))
    title, words = _name_parts(original)
    alone = len(words) == 1 and words[0] in _GIVEN_OF
    new = []
    for i, w in enumerate(words):
        own = "name" if i == 0 and w in _GIVEN_OF else "surname"
        # before a surname a given name always takes its first surrogate: the surname keeps the names distinct
        new.append(surrogate(own, w, key, retried.get((own, w), 0) if own == "surname" or alone else 0))
    return title + " ".join(new)


def replace_entities(text: str | None, key: str, retried: dict[tuple[str, str], int] | None = None) -> tuple[str | None, int]:
    """(text with surrogates, number of entities). retried: attempts of the atoms that collided."""
    spans = find_entities(text)
    if not spans or text is None:
        return text, 0
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], _new_mention(text[start:end], kind, key, retried or {})]
        at = end
    return "".join([*out, text[at:]]), len(spans)


# ---------------------------------------------------------------- over a corpus


def _entities(docs: DataFrame, key: str) -> DataFrame:
    """(kind, value, new) of each atom of the corpus, once. Dates of birth have no part in it: their permutation keeps them
    distinct, and as there are few dates, every one may be somebody's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = {a for t in b["text"] for s, e, k in find_entities(t) for a in atoms(t[s:e], k)}
            yield pd.DataFrame([(k, v, surrogate(k, v, key)) for k, v in sorted(seen) if k != "birth"], columns=["kind", "value", "new"])

    return spread(docs.select("text").where("text IS NOT NULL")).mapInPandas(run, "kind string, value string, new string").distinct()


def retried_entities(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate collides, with an attempt whose surrogate doesn't:
    not with a real entity of its kind, itself included, nor with another surrogate; of two that meet, the one of the
    smaller (attempt, value, kind) keeps it. RuntimeError if collisions remain that further attempts don't resolve."""
    key = params.key

    @F.pandas_udf("string")
    def again(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, v, key, int(a)) for k, v, a in zip(kind, value, attempt)], dtype="object")

    # surnames and given names that stand alone are one space: neither may become what another is
    space = F.when(F.col("kind") == "surname", "name").otherwise(F.col("kind"))
    now = materialize(_entities(docs, key).withColumn("attempt", F.lit(0)).withColumn("space", space), "entities")
    settled = now
    fewest, idle = None, 0
    while True:
        taken = now.groupBy("space", "new").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "value", "kind")).alias("first")).where("n > 1")
        met = now.join(taken, ["space", "new"]).where(F.struct("attempt", "value", "kind") != F.col("first")).select("kind", "value")
        real = now.join(settled.select("space", F.col("value").alias("new")), ["space", "new"], "left_semi").select("kind", "value")
        bad = materialize(met.unionByName(real).distinct(), "collisions")
        left = {r["kind"]: r["count"] for r in bad.groupBy("kind").count().collect()}  # one row a kind
        if not left:
            discard(bad)
            break
        many = sum(left.values())
        fewest, idle = (many, 0) if fewest is None or many < fewest else (fewest, idle + 1)
        if idle > params.attempts:
            raise RuntimeError(f"no free surrogates for {left}")
        moved = now.join(bad, ["kind", "value"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        moved = moved.withColumn("new", again("kind", "value", "attempt"))
        after = materialize(now.join(bad, ["kind", "value"], "left_anti").unionByName(moved.select(now.columns)), "entities")
        discard(bad, *([now] if now is not settled else []))
        now = after
    out = materialize(now.where("attempt > 0").select("kind", "value", "attempt"), "retried")
    discard(now, *([settled] if settled is not now else []))
    return out


def pseudonymize(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """docs with text replaced, other columns and all rows as they are.

    Null texts stay null and empty ones empty; whole texts are searched, however long. Repeated rows and ids get the same
    surrogates. No column name is reserved: helpers have names that no table has. An empty table gives an empty one.

    Retried entities are few (those that collide among the values of a shape) but may grow, so they aren't broadcast by
    hand: they are joined to the documents that mention them, and Spark broadcasts that table only where its size is
    known to be small."""
    spark, key = docs.sparkSession, params.key
    short_batches(spark)
    retried = retried_entities(docs, params)
    if retried.isEmpty():

        @F.pandas_udf("string")
        def plain(texts: pd.Series) -> pd.Series:
            return pd.Series([replace_entities(t, key)[0] for t in texts], dtype="object")

        return spread(docs).withColumn("text", plain("text"))

    @F.pandas_udf("array<string>")
    def mentions(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({f"{k}\x00{v}" for s, e, kind in find_entities(t) for k, v in atoms(t[s:e], kind)}) if t else [] for t in texts], dtype="object")

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, attempts: pd.Series) -> pd.Series:
        out = []
        for t, a in zip(texts, attempts):
            given = {tuple(x.split("\x00")[:2]): int(x.split("\x00")[2]) for x in (a if a is not None else [])}
            out.append(replace_entities(t, key, given)[0])
        return pd.Series(out, dtype="object")

    own = uuid.uuid4().hex
    tag, mention, some, attempt, given = (f"_{x}_{own}" for x in ("tag", "mention", "some", "attempt", "given"))
    coded = retried.select(F.concat_ws("\x00", "kind", "value").alias(mention), F.concat_ws("\x00", "kind", "value", F.col("attempt").cast("string")).alias(attempt))
    # texts are told apart by a hash of 128 bits: rows with the same text get the same attempts, whatever their ids
    hashed = F.struct(F.xxhash64("text").alias("a"), F.hash("text", F.lit(7)).alias("b"), F.length("text").alias("n"))
    docs = spread(docs)
    tagged = docs.select(hashed.alias(tag), mentions("text").alias(some)).where(F.size(some) > 0)
    per_text = tagged.select(tag, F.explode(some).alias(mention)).join(coded, mention).groupBy(tag).agg(F.collect_set(attempt).alias(given))
    per_text = materialize(per_text, "attempts")
    joined = docs.withColumn(tag, hashed).join(per_text, tag, "left")
    return joined.withColumn("text", replaced("text", given)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of every document, its personal data replaced."""
    return pseudonymize(table(spark, sf_dir, "documents")).select("doc_id", "text")


QUERIES = {"op4_pii": op4_pii}
ORACLE: dict[str, str] = {}
