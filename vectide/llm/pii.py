"""Personal data: surrogate generation.

Entities are found by patterns: e-mail addresses, phone, card and account numbers, national identifiers, IBANs, street,
IP and MAC addresses, secrets, and names after a form of address. Numbers count only in a form of their type: cards,
IBANs and DNIs whose check digits are right, phone numbers with a prefix, an area code, a trunk zero or a word such as
"tel" before them; so dates and ranges of years stay. A name that a document shows with a form of address is found
wherever it stands in that document with a capital, and a name of two words so found in any document is found in all.

Each entity gets a surrogate of its own type that follows the original's format: digits stay digits between the same
separators, hex stays hex in the same case, check digits stay right, names keep script, gender and case. Surrogates
come from a keyed digest of the entity, so an entity has the same one in every document, and the key is needed to
repeat them. A word of a name is one entity whatever stands around it; its gender is that of all the forms of address
it is seen with as a given name, and unknown if they differ or show none.

Documents are matched once and stored with the places of their entities. Distinct entities are gathered over all
documents, narrow and counted before they meet. Surrogates that two entities share, or that are an entity of the input
themselves, are drawn again; entities for which no free surrogate is found, as in a number space that is full, get a
label with a digest of their own instead. Documents then get their surrogates from the digest and from the list of the
entities that need a gender or another try.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vectide.llm.common import BROADCAST_ROWS, as_text, discard, spare, stored, table

#: The key of the registered query, whose results are compared and not published; every other use passes a secret one.
QUERY_KEY = b"vectide surrogates"
#: How often a surrogate is drawn before an entity gets a label instead.
ROUNDS = 40

# Forms of address by the gender they show; lower case, without a final full stop.
ADDRESSES = {
    "f": ("mrs", "ms", "miss", "madame", "mme", "mlle", "frau", "señora", "sra", "señorita", "srta", "signora", "госпожа", "г-жа", "κυρία"),
    "m": ("mr", "sir", "monsieur", "herr", "señor", "sr", "signor", "господин", "г-н", "κύριος"),
    "x": ("dr", "prof", "doctor", "professor", "mx"),
}
GENDER = {word: g for g, words in ADDRESSES.items() for word in words}
# Words before a phone number; words of streets after and before the name.
CUES = ("telephone", "telefon", "teléfono", "téléphone", "phone", "mobile", "mobil", "móvil", "portable", "tel", "fax", "cell", "call")
STREETS = ("street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "drive", "boulevard", "blvd", "square", "court", "terrace")
GERMAN_STREETS = ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee")
ROMANCE_STREETS = ("rue", "avenue", "boulevard", "place", "calle", "avenida", "plaza", "paseo", "via", "piazza")
# The check letters of the Spanish DNI by remainder.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

#: What may stand before a form of address, and how secrets begin that need no digit.
OPENING = "([{\"'«“„‘¿¡*/#<>–—-"
MARKS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-")

_WORD = r"[^\W\d_]"
_UPPER = r"(?:(?=[^\W\d_])[A-ZÀ-ÖØ-ÞĀ-ſΑ-ΩА-Я])"
_TITLE = "|".join(sorted((re.escape(w) for w in GENDER), key=len, reverse=True))


def _any(words: Iterable[str]) -> str:
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


#: Types in order of precedence where they overlap at one place.
PATTERNS = {
    "email": (
        r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+"
        r"|[^\W_][\w.%+\-]*@[^\W_][\w\-]*(?:\.[^\W_][\w\-]*)+"
    ),
    "secret": (
        r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}"
        r"|sk-[0-9A-Za-z]{20,}|xox[abp]-[0-9A-Za-z\-]{10,})(?![0-9A-Za-z])"
    ),
    "mac": r"(?<![0-9A-Fa-f:\-])[0-9A-Fa-f]{2}(?:([:\-])[0-9A-Fa-f]{2})(?:\1[0-9A-Fa-f]{2}){4}(?![0-9A-Fa-f:\-])",
    "ip6": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "dni": r"(?<![0-9A-Za-z])\d{8}-?[A-HJ-NP-TV-Z](?![0-9A-Za-z])",
    "nino": r"(?<![0-9A-Za-z])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z](?: ?\d{2}){3} ?[A-D](?![0-9A-Za-z])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{4,5})(?!\d)",
    "phone": (
        r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}"  # international
        r"|\(\d{2,5}\)[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}"  # an area code in brackets
        r"|(?<!\d[ .\-])\d{3}([ .\-])\d{3}\1\d{4}(?![ .\-]\d)"  # three, three and four digits
        r"|0\d(?:([ .])\d\d)(?:\2\d\d){3}|0\d{2,4}[ /\-]\d{3,4}(?:[ \-]?\d{2,4}){0,2}(?![ .\-/]?\d)"  # a trunk zero
        rf"|(?i:{_any(CUES)})\b[.:]? ?\+?\d{{2,4}}(?:[ .\-/]?\d{{2,4}}){{1,4}})(?!\w)"
    ),
    "address": (
        rf"(?<!\w)(?:\d{{1,5}}[A-Za-z]? (?:{_UPPER}[\w'’\-]* ){{1,3}}(?i:{_any(STREETS)})\b\.?"
        rf"|{_UPPER}[\w\-]*(?:{_any(GERMAN_STREETS)}) \d{{1,4}}[a-z]?\b"
        rf"|\d{{1,4}},? (?:{_any(ROMANCE_STREETS)}) (?:(?:de|du|des|la|le|del|los|las) ){{0,2}}{_UPPER}[\w'’\-]*"
        rf"|(?i:{_any(ROMANCE_STREETS)}) (?:(?:de|du|des|la|le|del|los|las) ){{0,2}}(?:{_UPPER}[\w'’\-]* ?){{1,3}},? \d{{1,4}}\b)"
    ),
    "person": rf"(?<![^\s{re.escape(OPENING)}])(?i:{_TITLE})\.? +{_WORD}[\w'’\-]*(?: +{_WORD}[\w'’\-]*){{0,2}}",
}
FOUND = {name: re.compile(p) for name, p in PATTERNS.items()}
#: What each type cannot do without; a plain and quick look before its pattern.
NEEDS = {
    "email": re.compile("@"),
    "secret": re.compile(r"[0-9A-Fa-f]{32}|AKIA|gh[pousr]_|sk-|xox[abp]-"),
    "mac": re.compile(r"[0-9A-Fa-f]{2}[:\-][0-9A-Fa-f]{2}[:\-]"),
    "ip6": re.compile(r":[0-9A-Fa-f]{0,4}:"),
    "ip": re.compile(r"\d\.\d{1,3}\.\d"),
    "iban": re.compile(r"[A-Z]{2}\d\d"),
    "ssn": re.compile(r"\d-\d\d-\d"),
    "dni": re.compile(r"\d{8}"),
    "nino": re.compile(r"[A-Z]{2} ?\d\d"),
    "card": re.compile(r"\d[ \-]?\d{2}[ \-]?\d"),
    "phone": re.compile(r"\d{2,4}[ .\-/)]+\d{2}|\+\d|\d{6}"),
    "address": re.compile(r"\d,? ?[A-Za-z]|[a-z.] \d"),
}
_DIGIT = re.compile(r"[\d@]")
_HEX = re.compile(r"[0-9a-f]{32}|(?:[0-9a-f]{2}[:\-]){5}")
_OPENED = re.compile(f"[{re.escape(OPENING)}]")
_TITLES = {*GENDER, *(f"{w}." for w in GENDER)}
_POSSESSIVE = re.compile(r"['’](?:s|S)?$|\-+$")

# Syllables of made-up names by script, and endings that show the gender.
SYLLABLES = {
    "LATIN": (
        "ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu",
        "va", "we", "xi", "yo", "zu", "bre", "cli", "dro", "fla", "gri", "kra", "plo", "sta", "tre", "vin",
    ),
    "CYRILLIC": ("ба", "ве", "ги", "до", "жу", "за", "ки", "ло", "му", "на", "пе", "ри", "со", "ту", "фа", "хе", "цы", "чо", "шу", "ява"),
    "GREEK": ("βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "φε", "χι", "ψο", "λω", "μη", "νυ", "ρα"),
}
ENDINGS = {
    "LATIN": {"f": "a", "m": "en", "x": "is"},
    "CYRILLIC": {"f": "ова", "m": "ов", "x": "ко"},
    "GREEK": {"f": "ου", "m": "ος", "x": "ις"},
}
DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def script(text: str) -> str:
    """The script of the first letter that has a known one."""
    for c in text:
        name = unicodedata.name(c, "").split(" ")[0]
        if name in SYLLABLES:
            return name
    return "LATIN"


# check digits


def luhn(digits: str) -> int:
    """The checksum of card numbers, 0 if it is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10


def mod97(iban: str) -> int:
    """The remainder of an IBAN without blanks, 1 if its check digits are right."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _address6(surface: str) -> str | None:
    """The full form of an IPv6 address that can belong to somebody."""
    try:
        found = ipaddress.IPv6Address(surface)
    except ValueError:
        return None
    return found.exploded if sum(bool(x) for x in surface.split(":")) >= 3 else None


# mentions


def canonical(kind: str, surface: str) -> str | None:
    """What makes two mentions the same entity; None if the check digits or the form show that it is none."""
    if kind == "email":
        return surface.lower()
    if kind in ("secret", "ip"):
        return surface
    if kind == "ip6":
        return _address6(surface)
    if kind == "mac":
        return re.sub(r"[:\-]", "", surface).lower()
    if kind in ("iban", "dni", "nino"):
        plain = re.sub(r"[ \-]", "", surface)
        ok = {"iban": lambda: mod97(plain) == 1, "dni": lambda: DNI_LETTERS[int(plain[:8]) % 23] == plain[8], "nino": lambda: True}
        return plain if ok[kind]() else None
    if kind == "address":
        return re.sub(r"[\W_]+", " ", surface).lower().strip()
    digits = re.sub(r"\D", "", surface)
    if kind == "card" and luhn(digits) or kind == "phone" and not 7 <= len(digits) <= 15:
        return None
    return digits


def person(word: str) -> str:
    """The canonical form of a word of a name: script and lower case."""
    return f"{script(word)}:{word.lower()}"


def _names(text: str, m: re.Match) -> list[tuple[int, int, str]]:
    """Place and gender of each capitalised word after a form of address; the last one is a family name, which shows no gender."""
    title = re.match(rf"(?i:({_TITLE})\.?) +", m[0])
    gender, words = GENDER[title[1].lower()], []
    for w in re.finditer(rf"{_WORD}[\w'’\-]*", m[0][title.end() :]):
        if not w[0][0].isupper():
            break
        at = m.start() + title.end() + w.start()
        words.append((at, at + len(_POSSESSIVE.sub("", w[0]))))
    return [(a, b, gender if k < len(words) - 1 else "x") for k, (a, b) in enumerate(words)]


_JOINED = re.compile(rf"(?<!\w)(?=({_UPPER}[\w\-]*) ({_UPPER}[\w\-]*))")


def pairs(text: str) -> Iterator[tuple[int, int, int, int]]:
    """The places of each two capitalised words that a blank joins, the second without a possessive."""
    for m in _JOINED.finditer(text):
        yield m.start(1), m.end(1), m.start(2), m.end(2)


def titled(words: set[str]) -> bool:
    """Whether one of a text's words in lower case is a form of address, perhaps after what may stand before it."""
    if not _TITLES.isdisjoint(words):
        return True
    return any(not _TITLES.isdisjoint(_OPENED.split(w)) for w in words if not w.isalnum())


def hinted(text: str, words: set[str]) -> bool:
    """Whether the text can hold an entity at all: no pattern matches without a digit, an @, a colon, the mark of a secret, a form of address, or the letters of a long hexadecimal number or a MAC address."""
    if _DIGIT.search(text) or ":" in text or any(m in text for m in MARKS):
        return True
    return titled(words) or any(len(w) >= 17 and _HEX.search(w) for w in words)


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """start, end, gender, type and canonical form of whatever is replaced, in order and without overlaps; a place belongs to the first type that matches."""
    words = set(text.lower().split())
    if not hinted(text, words):
        return []
    found: list[tuple[int, int, str, str, str]] = []
    free = _Free()
    names: set[str] = set()
    for kind, pattern in FOUND.items():
        if not (titled(words) if kind == "person" else NEEDS[kind].search(text)):
            continue
        for m in pattern.finditer(text):
            if kind == "person":
                for a, b, gender in _names(text, m):
                    if free.take(a, b):
                        found.append((a, b, gender, kind, person(text[a:b])))
                        names.add(text[a:b])
                continue
            a = m.start()
            if kind == "phone" and not (text[a].isdigit() or text[a] in "+("):
                a += re.search(r"[+\d]", m[0]).start()
            canon = canonical(kind, text[a : m.end()])
            if canon and free.take(a, m.end()):
                found.append((a, m.end(), "x", kind, canon))
    if names:
        forms = {f for n in names if len(n) > 1 for f in (n, n.upper(), n[:1].upper() + n[1:].lower())}
        for m in re.finditer(rf"(?<!\w)(?:{_any(forms)})(?!\w)", text) if forms else ():
            if free.take(m.start(), m.end()):
                found.append((m.start(), m.end(), "x", "person", person(m[0])))
    return sorted(found)


def mentions(text: str) -> Iterator[tuple[int, int, str]]:
    """start, end and type of each entity."""
    for a, b, _, kind, _ in entities(text):
        yield a, b, kind


class _Free:
    """The places of a text that no entity has taken yet."""

    def __init__(self):
        self.taken: dict[int, list[tuple[int, int]]] = {}

    def take(self, a: int, b: int) -> bool:
        """Take a place if all of it is free; places are kept by stretches of 256 characters."""
        spans = range(a >> 8, (b - 1 >> 8) + 1)
        if any(x < b and a < y for s in spans for x, y in self.taken.get(s, ())):
            return False
        for s in spans:
            self.taken.setdefault(s, []).append((a, b))
        return True


# surrogates


class Draw:
    """Numbers from a keyed digest of an entity and the number of the try."""

    def __init__(self, key: bytes, kind: str, canonical: str, tries: int):
        data = hmac.new(key, f"{kind}\0{canonical}\0{tries}".encode(), hashlib.sha512).digest()
        self.key, self.data, self.n = key, data, int.from_bytes(data, "big")
        self.left = 460

    def below(self, n: int) -> int:
        if self.left < 64:
            self.data = hmac.new(self.key, self.data, hashlib.sha512).digest()
            self.n, self.left = int.from_bytes(self.data, "big"), 460
        self.n, out = divmod(self.n, n)
        self.left -= n.bit_length()
        return out

    def word(self, alphabet: str, size: int) -> str:
        return "".join(alphabet[self.below(len(alphabet))] for _ in range(size))


def _like(d: Draw, c: str, alphabet: str | None = None) -> str:
    """A character of the kind of c."""
    if alphabet and c.lower() in alphabet:
        x = alphabet[d.below(len(alphabet))]
        return x.upper() if c.isupper() else x
    if c.isdigit():
        return DIGITS[d.below(10)]
    x = LOWER[d.below(26)]
    return x.upper() if c.isupper() else x if c.islower() else c


def _made_word(d: Draw, where: str, size: int, gender: str) -> str:
    return "".join(SYLLABLES[where][d.below(len(SYLLABLES[where]))] for _ in range(size)) + ENDINGS[where][gender]


def label(key: bytes, kind: str, canon: str) -> str:
    """What an entity gets if every surrogate drawn is taken; no pattern finds it and no two entities share it."""
    return f"[{kind}#{hmac.new(key, f'{kind}#{canon}'.encode(), hashlib.sha256).hexdigest()[:31].translate(str.maketrans(DIGITS, 'ghijklmnop'))}]"


@lru_cache(200_000)
def surrogate(key: bytes, kind: str, canon: str, gender: str = "x", tries: int = 0) -> str:
    """The canonical form of an entity's surrogate; tries below 0 ask for its label."""
    if tries < 0:
        return label(key, kind, canon)
    for again in range(64):  # a draw that gives the entity back is drawn again
        out = _drawn(Draw(key, kind, canon, tries + 1000 * again), kind, canon, gender, tries)
        if out != canon:
            return out
    return out


def _drawn(d: Draw, kind: str, canon: str, gender: str, tries: int) -> str:
    if kind == "email":
        local, _, domain = canon.partition("@")
        top = domain.rpartition(".")[2]
        size = max(7, min(len(local), 24) - 3)
        return f"{d.word(LOWER, 3)}{d.word(LOWER + DIGITS, size)}@{d.word(LOWER, 6)}.{top if top.isascii() else 'org'}"
    if kind == "secret":
        keep = re.match(r"AKIA|gh[pousr]_|sk-|xox[abp]-", canon)
        head = keep[0] if keep else ""
        return head + "".join(_like(d, c, None if head else HEX) for c in canon[len(head) :])
    if kind == "mac":
        return d.word(HEX, 12)
    if kind == "ip":
        return ".".join(str(d.below(256)) for _ in range(4))
    if kind == "ip6":
        # groups of zeros stay, so that the short form is as short; the others stay as long
        groups = [g.lstrip("0") for g in canon.split(":")]
        return ":".join((HEX[1 + d.below(15)] + d.word(HEX, len(g) - 1) if g else "").rjust(4, "0") for g in groups)
    if kind == "iban":
        body = "".join(_like(d, c) for c in canon[4:])
        return f"{canon[:2]}{98 - mod97(canon[:2] + '00' + body):02d}{body}"
    if kind == "dni":
        body = d.word(DIGITS, 8)
        return body + DNI_LETTERS[int(body) % 23]
    if kind == "nino":
        return "".join("ABCEHJKLM"[d.below(9)] for _ in range(2)) + d.word(DIGITS, 6) + "ABCD"[d.below(4)]
    if kind == "person":
        return f"{canon.split(':', 1)[0]}:{_made_word(d, canon.split(':', 1)[0], 3 + tries // 4, gender)}"
    if kind == "address":
        words = []
        for w in canon.split(" "):
            street = w in STREETS or w in ROMANCE_STREETS or w in ("str", "de", "du", "des", "la", "le", "del", "los", "las")
            end = next((e.rstrip(".") for e in GERMAN_STREETS if w.endswith(e.rstrip(".")) and len(w) > len(e)), "")
            if w[0].isdigit():
                words.append(str(1 + d.below(9)) + "".join(_like(d, c) if c.isdigit() else c for c in w[1:]))
            else:
                words.append(w if street else _made_word(d, script(w), 2 + tries // 4, "x") + end)
        return " ".join(words)
    first = "0" if canon[0] == "0" else DIGITS[1 + d.below(9)]
    if kind == "card":
        body = first + d.word(DIGITS, len(canon) - 2)
        check = next(c for c in DIGITS if luhn(body + c) == 0)
        return body + (check if luhn(canon) == 0 else DIGITS[(int(check) + 1 + d.below(9)) % 10])
    return first + d.word(DIGITS, len(canon) - 1)


def cased(surface: str, word: str) -> str:
    """A word in the case of another: all capitals, or a capital first."""
    return word.upper() if len(surface) > 1 and surface.isupper() else word[:1].upper() + word[1:]


def shaped(kind: str, surface: str, new: str) -> str:
    """A surrogate in the format of a mention: the same separators and case."""
    if new.startswith("["):
        return new
    if kind == "person":
        return cased(surface, new.split(":", 1)[1])
    if kind == "email":
        return new.upper() if surface.isupper() else new
    if kind in ("secret", "ip"):
        return new
    if kind == "ip6":
        full = all(len(g) == 4 for g in surface.split(":")) and surface.count(":") == 7
        out = new if full else ipaddress.IPv6Address(new).compressed
        return out.upper() if surface.upper() == surface else out
    if kind == "address":
        words = iter(new.split(" "))

        def word(m: re.Match) -> str:
            w = next(words)
            if m[0][0].isdigit():
                return "".join(y if y.isdigit() else x for x, y in zip(m[0], w, strict=True))
            return cased(m[0], w) if m[0][0].isupper() else w

        return re.sub(r"[^\W_]+", word, surface)
    chars, out = iter(new), []
    for c in surface:
        if c.isalnum():
            x = next(chars)
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def replaced(
    text: str, key: bytes, listed: dict[tuple[str, str], tuple[str, int]], spans: list[tuple[int, int, str, str, str]] | None = None
) -> tuple[str, list[str]]:
    """The text with surrogates for its entities (by default those found here), and the types replaced in order."""
    out, at, kinds = [], 0, []
    for a, b, _, kind, canon in entities(text) if spans is None else spans:
        out += [text[at:a], shaped(kind, text[a:b], surrogate(key, kind, canon, *listed.get((kind, canon), ("x", 0))))]
        at = b
        kinds.append(kind)
    return "".join([*out, text[at:]]) if kinds else text, kinds


# tables

_FIELDS = ("a", "b", "gender", "kind", "canon")
_SPANS = "array<struct<a int, b int, gender string, kind string, canon string>>"
_SPAN = pa.list_(pa.struct([(f, pa.int32() if f in "ab" else pa.string()) for f in _FIELDS]))


def matched(rows: DataFrame, text: str, spans: str) -> DataFrame:
    """rows with their entities; the one pass that looks for them."""
    schema = StructType(rows.schema.fields[:]).add(spans, StructType.fromDDL(f"x {_SPANS}")[0].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[dict(zip(_FIELDS, e, strict=True)) for e in entities(t)] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, _SPAN)], names=schema.names)

    return rows.mapInArrow(work, schema)


def distinct_entities(rows: DataFrame, key: bytes, spans: str) -> DataFrame:
    """kind, canon, gender, fake (first try) of each distinct entity."""
    each = rows.where(F.size(spans) > 0).select(F.explode(spans).alias("e")).select("e.kind", "e.canon", "e.gender")
    seen = each.groupBy("kind", "canon").agg(*[F.max(F.col("gender") == g).alias(g) for g in "fm"])
    gender = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("x")
    return stored(_with_fakes(seen.select("kind", "canon", gender.alias("gender"), F.lit(0).alias("tries")), key), "pii-entities")


def _with_fakes(rows: DataFrame, key: bytes) -> DataFrame:
    """rows (kind, canon, gender, tries) with their surrogates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fakes = [surrogate(key, *r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fakes, pa.string())], names=["kind", "canon", "gender", "tries", "fake"])

    return rows.mapInArrow(work, "kind string, canon string, gender string, tries int, fake string")


def collisions(found: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """kind, canon, gender, tries of the entities whose surrogate isn't the first of an unknown gender.

    Of entities with one surrogate the smallest keeps it. A surrogate that is an entity of the input is given up, so
    that nobody is taken for somebody else. Each round draws anew for those left over and checks against all in use;
    those still left after the last have -1 tries, which stands for their label.
    """
    real = found.select("kind", F.col("canon").alias("fake"))
    used, spent = found, []
    for k in range(1, rounds + 2):
        first = used.groupBy("kind", "fake").agg(F.min("canon").alias("first"), F.count("*").alias("n"))
        shared = used.join(first.where("n > 1"), ["kind", "fake"]).where("canon <> first")
        taken = used.join(real, ["kind", "fake"], "left_semi")
        bad = stored(shared.select("kind", "canon", "gender").unionByName(taken.select("kind", "canon", "gender")).distinct(), f"pii-again-{k}")
        if bad.isEmpty():
            discard(bad)
            break
        again = _with_fakes(bad.select("kind", "canon", "gender", F.lit(k if k <= rounds else -1).alias("tries")), key)
        new = stored(used.join(bad, ["kind", "canon"], "left_anti").unionByName(again), f"pii-used-{k}")
        discard(bad, *spent)
        used, spent = new, [new]
    out = stored(used.where("tries <> 0 or gender <> 'x'").select("kind", "canon", "gender", "tries"), "pii-listed")
    discard(*spent)
    return out


def full_names(rows: DataFrame, spans: str) -> DataFrame:
    """first, last (canonical forms) of each name of two words or more that some document shows with a form of address."""
    e = F.filter(spans, lambda x: x["kind"] == "person")
    near = F.zip_with(F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))), F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0))), lambda x, y: F.struct(x["canon"].alias("first"), y["canon"].alias("last"), (y["a"] - x["b"]).alias("gap"), x["gender"].alias("gender")))
    each = rows.where(F.size(spans) > 1).select(F.explode(near).alias("p")).where("p.gap = 1")
    return each.select("p.first", "p.last").distinct()


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, text with surrogates, n_entities and kinds (types in order) of each row.

    A null text is returned as empty, an empty or clean one as it is; texts are read whole, however long. Equal
    entities have equal surrogates in all rows, different ones of a type different surrogates; where two entities draw
    the same, the one whose canonical form is smaller keeps it. Repeated rows give equal rows. A type whose numbers are
    used up gets labels. An empty table gives no rows; other input columns may have any names.
    """
    spark = docs.sparkSession
    own_text, spans, uid, listed, more = (spare(x, keep) for x in ("_text", "_spans", "_uid", "_listed", "_more"))
    rows = matched(docs.select(*keep, as_text(text_col).alias(own_text)), own_text, spans)
    rows = stored(rows.withColumn(uid, F.monotonically_increasing_id()), "pii-rows")
    names = stored(full_names(rows, spans), "pii-names")
    few_names = names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few_names:
        known = {(r[0], r[1]) for r in names.collect()}
        rows_of = rows.withColumn(more, F.lit(None).cast("array<string>"))
    else:
        known = set()
        own = candidates(rows, uid, own_text).join(names, ["first", "last"])
        own = own.groupBy(F.col("_uid").alias(uid)).agg(F.collect_set(F.concat_ws("\0", "first", "last")).alias(more))  # of one text
        rows_of = rows.join(own, uid, "left")
    shared_names, columns = spark.sparkContext.broadcast(known), rows.columns

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full names that other documents show with a form of address."""
        for batch in batches:
            out = []
            for t, got, own in zip(*(batch.column(c).to_pylist() for c in (own_text, spans, more)), strict=True):
                names = {tuple(x.split("\0")) for x in own} if own else shared_names.value
                out.append(with_names(t, got, names) if names else got)
            at = batch.schema.get_field_index(spans)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, _SPAN)).select(columns)

    if not few_names or known:
        rows = stored(rows_of.mapInArrow(spread, rows.schema), "pii-spread")
    found = distinct_entities(rows, key, spans)
    tries = collisions(found, key)
    discard(found, names)

    schema = StructType(docs.select(*keep).schema.fields[:]).add("text", "string").add("n_entities", "integer")
    schema = StructType.fromDDL(schema.toDDL() + ", kinds array<string>")
    if tries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        shared = spark.sparkContext.broadcast({(r[0], r[1]): (r[2], r[3]) for r in tries.collect()})
        rows = rows.withColumn(listed, F.lit(None).cast("map<string,struct<gender:string,tries:int>>"))
    else:
        # too many for one broadcast: each row with an entity gets its own few by a join
        shared = spark.sparkContext.broadcast({})
        own = rows.where(F.size(spans) > 0).select(F.col(uid).alias("_uid"), F.explode(spans).alias("e")).select("_uid", "e.kind", "e.canon").distinct()
        own = own.join(tries, ["kind", "canon"])
        entry = F.struct(F.concat_ws("\0", "kind", "canon").alias("k"), F.struct("gender", "tries").alias("v"))
        own = own.groupBy(F.col("_uid").alias(uid)).agg(F.map_from_entries(F.collect_list(entry)).alias(listed))  # entities of one text
        rows = rows.join(own, uid, "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for t, places, own in zip(*(batch.column(c).to_pylist() for c in (own_text, spans, listed)), strict=True):
                some = {tuple(k.split("\0", 1)): (v["gender"], v["tries"]) for k, v in own} if own else shared.value
                got.append(replaced(t, key, some, [tuple(e[f] for f in _FIELDS) for e in places]))
            new = [pa.array([x[0] for x in got], pa.string()), pa.array([len(x[1]) for x in got], pa.int32()), pa.array([x[1] for x in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=schema.names)

    return rows.select(*keep, own_text, spans, listed).mapInArrow(work, schema)


def candidates(rows: DataFrame, uid: str, text: str) -> DataFrame:
    """_uid, first, last of each two joined capitalised words, once a text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = list({(person(t[a:b]), person(t[c:d])) for a, b, c, d in pairs(t)})
                yield pa.RecordBatch.from_arrays([pa.array([u] * len(got), pa.int64()), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.string())], names=["_uid", "first", "last"])

    return rows.select(uid, text).mapInArrow(work, "_uid long, first string, last string")


def with_names(text: str, got: list[dict], names: set[tuple[str, str]]) -> list[dict]:
    """A text's entities and, where they are free, its mentions of known full names."""
    free, more = None, []
    for a, b, c, d in pairs(text):
        first, last = person(text[a:b]), person(text[c:d])
        if (first, last) in names:
            if free is None:
                free = _Free()
                for e in got:
                    free.take(e["a"], e["b"])
            for x, y, canon in ((a, b, first), (c, d, last)):
                if free.take(x, y):
                    more.append({"a": x, "b": y, "kind": "person", "canon": canon, "gender": "x"})
    return sorted([*got, *more], key=lambda e: e["a"]) if more else got


def op5_surrogates(spark, sf_dir):
    return pseudonymise(table(spark, sf_dir, "documents"), QUERY_KEY)
