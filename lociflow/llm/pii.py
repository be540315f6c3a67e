"""Surrogates for personal data and secrets: keyed, of the same type, format, script and gender, and distinct where the originals are.

A surrogate is the original's place in the set of all strings of its format (the same classes of characters in the same places), moved on by a keyed
permutation without fixed points. So it depends on the key and the entity alone, which keeps mentions of one entity alike in all
documents, and two entities never get one surrogate; entity_table() and collisions() check that over the corpus.
"""

from __future__ import annotations

import hashlib
import ipaddress
import os
import re
import secrets
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import modest_batches, sliced
from lociflow.sources.shared import drop_written, written

#: Given names by gender (fixed values); a name in a list gets another of its list.
GIVEN = {
    "f": "Anna Alice Amelia Carla Carmen Charlotte Claire Elena Emma Eva Greta Hannah Helen Ingrid Isabel Jane Julia Karin Laura Lucia Maria Marie Martha Mary Monica Nina Nora Olivia Paula Rosa Ruth Sarah Sofia Susan Teresa Ursula".split(),
    "m": "Adam Albert Alexander Andreas Antonio Carlos Charles Daniel David Diego Edward Felix Frank George Hans Henry Hugo James Jan John Juan Karl Louis Luis Mark Martin Michael Oliver Oscar Paul Peter Pierre Robert Thomas Victor William".split(),
}
#: Titles that a name follows (fixed values).
TITLES = "Mr Mrs Ms Miss Mister Dr Prof Professor Doctor Sir Herr Frau Doktor Señor Señora Señorita Sr Sra Dra Don Doña Monsieur Madame Mme Mlle Signor Signora Dott господин госпожа доктор профессор".split()
#: Verbs of speech before which two names stand (fixed values).
SPEECH = "said wrote says writes asked replied sagte schrieb fragte dijo escribió preguntó".split()
#: Second levels of domains that stay with the country behind them, and beginnings of access tokens (fixed values).
SECOND_LEVELS, TOKENS = "co com org net ac gov edu", r"gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_"
LETTERS = {  # vowels and consonants of the scripts, in both cases
    "latin": ("aeiouy", "bcdfghjklmnpqrstvwxz"),
    "latin accents": ("áàâäãåéèêëíìîïóòôöõúùûü", "çñ"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
    "cyrillic": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"),
}
NAME_CLASSES = [c for pair in LETTERS.values() for group in pair for c in (group, group.upper())]
#: Combining marks, which letters of many scripts carry, as a class of a pattern: a rule over Unicode's categories.
MARKS = "".join(re.escape(chr(c)) for c in range(0x300, 0x1E000) if unicodedata.category(chr(c))[0] == "M")
#: Scripts that write words without spaces, or endings right behind names, by the first word of their letters' names.
UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "THAI", "LAO", "KHMER", "MYANMAR")
#: Calling codes of one and of two digits (fixed values); all others have three.
CALLING = {1: "1 7".split(), 2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
DIGITS, HEX, LOWER, UPPER, BASE32 = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RESERVED = re.compile(rf"(?:^|\.)(?:example\.(?:com|net|org)|(?:{SECOND_LEVELS.replace(' ', '|')})\.[a-z]{{2}}|[^\W\d_]{{2,}})$", re.I)

#: What any entity has: a digit, an @, one of these words in any case, or a title.
SIGNS, WORDS, REACH = re.compile("[0-9@]+"), ["password", "passwd", "pwd", "secret", "token", "api"], 160
#: What names a secret, in any case; alone, or with more words of an identifier on either side (underscores, hyphens, a capital, digits).
KEYWORDS = r"(?:password|passwd|pwd|secret|token|api[_-]?key)"
_ASCII_LOWER = {ord(c): c.lower() for c in UPPER}

LETTER = rf"(?:[^\W\d_][{MARKS}]*)"
NAME = rf"(?![a-zа-яα-ω])(?:[A-Z]['’](?=[A-Z]))?{LETTER}{{2,}}(?:-(?![a-zа-яα-ω]){LETTER}{{2,}})?"
INITIALS = r"(?:[A-ZÀ-ÞА-Я]\. ?){0,3}"
KNOWN = rf"(?:{'|'.join(x for names in GIVEN.values() for n in names for x in (n, n.upper()))})(?= (?![a-zа-яα-ω])[^\W\d_])"
KNOWN_SIGN = re.compile(KNOWN)  # begins with a letter of a few, which a search skips to
PATTERNS = re.compile(
    "|".join(
        [
            r"(?P<email>(?<![\w.+-])[^\W_][\w.%+-]*@[^\W_](?:[\w-]*\.)+[^\W\d_]{2,})",
            rf"(?P<token>(?<![\w-])(?:{TOKENS})[A-Za-z0-9_-]{{16,}})",
            r"(?P<awskey>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)",
            rf"(?P<secret>(?:(?<![^\W\d_])|(?<=[a-z])(?=[A-Z]))(?i:{KEYWORDS}\d*(?:[_-]+(?!{KEYWORDS})[A-Za-z0-9]*)*+)[\"']?\s?[=:]\s?[\"']?(?=[_+/-]*[A-Za-z0-9])[A-Za-z0-9_+/-]{{8,}})",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){7})[0-9A-Fa-f:]{6,39}(?<!:)(?![\w:]|\.\d))",
            r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))",
            r"(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?![\w-])|(?<![\w(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])|(?<![\w.+/-])0[1-9]\d{1,3}[ /-]\d{3,4}[ -]?\d{3,5}(?![\w-]|[.,]\d))",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))",
            rf"(?P<person>\b(?:(?:{'|'.join(TITLES)})\b\.? )+{INITIALS}{NAME}(?: {INITIALS}{NAME}){{0,2}})",
            rf"(?P<known>\b{KNOWN}(?: {NAME}){{1,2}})",
            rf"(?P<speaker>\b{NAME} {INITIALS}{NAME}(?= (?:{'|'.join(SPEECH)})\b))",
        ]
    )
)


def _round(key: bytes, tweak: bytes, i: int, half: int, bits: int) -> int:
    return int.from_bytes(hashlib.blake2b(tweak + bytes([i]) + half.to_bytes((bits + 7) // 8, "big"), key=key, digest_size=64).digest() * (bits // 512 + 1), "big") & ((1 << bits) - 1)


class Permutation:
    """A keyed permutation of range(size) that is one cycle: no number keeps its place."""

    def __init__(self, size: int, key: bytes, tweak: bytes):
        self.size, self.key, self.tweak, self.bits = size, key, tweak, max(1, ((size - 1).bit_length() + 1) // 2)

    def _mix(self, x: int, rounds: range) -> int:
        a, b = x >> self.bits, x & ((1 << self.bits) - 1)
        for i in rounds:
            if rounds.step > 0:
                a, b = b, a ^ _round(self.key, self.tweak, i, b, self.bits)
            else:
                a, b = b ^ _round(self.key, self.tweak, i, a, self.bits), a
        return a << self.bits | b

    def _walk(self, x: int, rounds: range) -> int:
        x = self._mix(x, rounds)
        while x >= self.size:
            x = self._mix(x, rounds)
        return x

    def next(self, x: int) -> int:
        return self._walk((self._walk(x, range(0, 8)) + 1) % self.size, range(7, -1, -1))


#: Characters that are one number of a permutation; longer texts go in blocks of about that many.
BLOCK_CHARS = 64


def disguise(text: str, kind: str, key: bytes, classes: list[str], ok: Callable[[str], object] = lambda s: None) -> str:
    """Another string with characters of the same classes in the same places, others unchanged, for which ok() gives the same as for the text.

    A long text is disguised block after block, so that time is linear in its length; each block's permutation depends on all that stands before it, and ok(), which must depend on the end of
    a text alone or on what nearly no other text has, is kept by the last one.
    """
    if len(text) <= BLOCK_CHARS:
        return _block(text, kind, key, classes, ok)
    n = -(-len(text) // BLOCK_CHARS)
    cuts = [len(text) * k // n for k in range(n + 1)]
    made, chain, want = [], kind, ok(text)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        held = "".join(made) if k + 1 == n else ""
        made.append(_block(text[a:b], chain, key, classes, (lambda s: want if s == text[a:b] else ok(held + s)) if k + 1 == n else lambda s: None))
        chain = hashlib.blake2b(f"{chain}\0{text[a:b]}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return "".join(made)


def _block(text: str, kind: str, key: bytes, classes: list[str], ok: Callable[[str], object] = lambda s: None) -> str:
    """disguise() of a text that is one number."""
    which = [next((c for c in classes if ch in c), None) for ch in text]
    size = 1
    for c in which:
        size *= len(c) if c else 1
    if size < 2:
        return text
    shape = "\0".join(c or ch for c, ch in zip(which, text))
    permutation, want, x = Permutation(size, key, hashlib.blake2b(f"{kind}\0{shape}".encode("utf-8", "surrogatepass"), digest_size=16).digest()), ok(text), 0
    for c, ch in zip(which, text):
        if c:
            x = x * len(c) + c.index(ch)
    while True:
        x = permutation.next(x)
        rest, out = x, []
        for c, ch in zip(reversed(which), reversed(text)):
            if c:
                rest, at = divmod(rest, len(c))
                ch = c[at]
            out.append(ch)
        if ok(made := "".join(reversed(out))) == want:
            return made


def _hex(text: str) -> list[str] | None:
    """The class of hexadecimal digits that the text is of, if any."""
    return next(([c] for c in (HEX, HEX.upper()) if not set(text) - set(c)), None)


def luhn(text: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed([c for c in text if c.isdigit()])):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _ip_kind(text: str) -> tuple:
    """What of an address must stay: whether it is private, loopback or otherwise not of a host anywhere; that octets are octets."""
    octets = [int(x) for x in text.split(".")]
    return octets[0] if octets[0] in (0, 10, 127) else None, octets[0] >= 224, octets[:2] == [192, 168]


def _ip(text: str, key: bytes) -> str:
    permutation, x = Permutation(1 << 32, key, b"ip"), 0
    for octet in text.split("."):
        x = x << 8 | int(octet)
    while True:
        x = permutation.next(x)
        made = ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
        if _ip_kind(made) == _ip_kind(text):
            return made


def _ip6(text: str, key: bytes) -> str:
    """The address as it is usually written, with other digits; empty groups, what a group leads with being no zero, and the ranges of documentation, links, sites and groups stay."""
    groups = ipaddress.IPv6Address(text).compressed.split(":")
    kept = 2 if groups[:2] == ["2001", "db8"] else int(groups[0][:2] in ("fe", "fc", "fd", "ff"))
    head, rest = ":".join(groups[:kept]), ":".join(groups[kept:])
    made = disguise(rest, f"ip6 {kept}", key, [HEX], lambda s: [g[:1] in ("", "0") for g in s.split(":")])
    return f"{head}:{made}" if head else made


def _addressed(text: str) -> bool:
    """Whether the text is an address of the longer kind, and no scope of a program's names or a time."""
    try:
        groups = ipaddress.IPv6Address(text).compressed.split(":")
    except ValueError:
        return False
    return sum(bool(g) for g in groups) >= 3 and any(c.isdigit() for c in text)


def _digits(text: str, kind: str, key: bytes, kept: int, ok, same: int | None = None) -> str:
    """text with its digits behind the first `kept` ones disguised, whatever stands between them; three from the `same`th of those stay."""
    digits = "".join(c for c in text if c.isdigit())
    head, rest, middle = digits[:kept], digits[kept:], ""
    if same is not None:
        rest, middle = rest[:same] + rest[same + 3 :], rest[same : same + 3]
    whole = lambda s: head + (s[:same] + middle + s[same:] if middle else s)
    made = iter(whole(disguise(rest, kind + middle, key, [DIGITS], lambda s: ok(whole(s)))))
    return "".join(next(made) if c.isdigit() else c for c in text)


def _national(text: str) -> tuple[int, str]:
    """How many digits of a phone number stay (the calling code), and its digits; the same however it is spaced."""
    digits = "".join(c for c in text if c.isdigit())
    return next((n for n, codes in CALLING.items() if digits[:n] in codes), 3) if text[0] == "+" else int(text[0] == "0"), digits


def mod97(text: str) -> bool:
    """Whether an account number's check digits hold."""
    t = "".join(c for c in text if c.isalnum())
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _iban(text: str, key: bytes) -> str:
    """The country stays, the check digits hold if they did, and spaces stand where they stood."""
    compact = text.replace(" ", "")
    made = iter(compact[:2] + disguise(compact[2:], "iban " + compact[:2], key, [DIGITS, UPPER], lambda s: mod97(compact[:2] + s)))
    return "".join(c if c == " " else next(made) for c in text)


@lru_cache(maxsize=100_000)
def _alike(letter: str) -> str | None:
    """The letters of a letter's script and case around it (256 code points), from Unicode's data, without those of NAME_CLASSES; None if it is the only one."""
    kind = lambda c: (unicodedata.category(c), unicodedata.name(c, "").split(" ")[0])
    start = ord(letter) & ~0xFF
    found = "".join(chr(c) for c in range(start, start + 256) if kind(chr(c)) == kind(letter) and not any(chr(c) in known for known in NAME_CLASSES))
    return found if len(found) > 1 else None


def _classes(text: str) -> list[str]:
    """The classes of the letters of a text beyond those of ASCII, in a fixed order."""
    wide = {ch for ch in text if ch.isalpha() and not ch.isascii()}
    return sorted({c for ch in wide if (c := next((known for known in NAME_CLASSES if ch in known), None) or _alike(ch))})


def _tail(word: str) -> str:
    """The end of a name that may show the gender and stays."""
    return re.search(r"(?:ova|eva|ina|ова|ева|ина|[aаα]|ой)?$", word[1:])[0]


def _person(word: str, key: bytes) -> str:
    """Another name of the gender, script and format; a last vowel, which may show the gender, stays."""
    for names in GIVEN.values():
        for own in (names, [n.upper() for n in names]):
            if word in own:
                return own[Permutation(len(own), key, names[0].encode()).next(own.index(word))]
    tail = _tail(word)
    stem = word[: len(word) - len(tail)]
    kind = lambda s: (any(x in names for names in GIVEN.values() for x in (s + tail, (s + tail).capitalize())), _tail(s + tail))
    classes = [*NAME_CLASSES, *(c for c in _classes(stem) if c not in NAME_CLASSES)]
    return disguise(stem, f"person {tail}", key, classes, kind) + tail


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The entity's surrogate; a keyed hash where its format holds no other string. Takes time in proportion to the entity's length; only short ones are remembered."""
    return (_remembered if len(text) < 200 else _surrogate)(kind, text, key)


def _surrogate(kind: str, text: str, key: bytes) -> str:
    made = _formed(kind, text, key)
    return made if made != text else hashlib.blake2b(f"{kind}\0{text}".encode("utf-8", "surrogatepass"), key=key, digest_size=12).hexdigest()


_remembered = lru_cache(maxsize=100_000)(_surrogate)


def _formed(kind: str, text: str, key: bytes) -> str:
    if kind == "email":
        local, _, domain = text.rpartition("@")
        kept = RESERVED.search(domain)[0]
        host = domain[: len(domain) - len(kept)]
        own = lambda s: [LOWER, DIGITS, *_classes(s)]
        return f"{disguise(local.lower(), 'local', key, own(local.lower()))}@{disguise(host.lower(), 'host', key, own(host.lower()))}{kept}"
    if kind == "token":
        begin = re.match(TOKENS, text)[0]
        return begin + disguise(text[len(begin) :], kind, key, [LOWER, UPPER, DIGITS])
    if kind == "awskey":
        return text[:4] + disguise(text[4:], kind, key, [UPPER + DIGITS])
    if kind == "secret":
        value = re.search(r"[A-Za-z0-9_+/-]+$", text)[0]
        return text[: -len(value)] + disguise(value, kind, key, _hex(value) or [LOWER, UPPER, DIGITS], _hex)
    if kind == "iban":
        return _iban(text, key)
    if kind == "ip":
        return _ip(text, key)
    if kind == "ip6":
        return _ip6(text, key)
    if kind == "phone":
        kept, digits = _national(text)
        fiction = len(digits) - kept == 10 and digits[kept + 3 : kept + 6] == "555"
        return _digits(text, kind, key, kept, lambda s: (s[kept:][:1] > "1", len(s) - kept == 10 and s[kept + 3 : kept + 6] == "555"), 3 if fiction else None)
    if kind == "ssn":
        return _digits(text, kind, key, 0, lambda s: (s[:3] in ("000", "666"), s[0] == "9", s[3:5] == "00", s[5:] == "0000"))
    if kind == "card":
        return _digits(text, kind, key, 1, luhn)
    return _person(text, key)


def _near(text: str) -> list[tuple[int, int]]:
    """The stretches of the text, in order, that can hold entities: what lies around a sign or word, out to white space."""
    at = [(m.start(), m.end()) for m in SIGNS.finditer(text)]
    low = text.translate(_ASCII_LOWER) if len(text.lower()) != len(text) else text.lower()
    at += [(m.start(), m.end()) for m in KNOWN_SIGN.finditer(text)]
    for word, where in [*((w, low) for w in WORDS), *((t, text) for t in (*TITLES, *(f" {v}" for v in SPEECH)))]:
        i = where.find(word)
        while i >= 0:
            at.append((i, i + len(word)))
            i = where.find(word, i + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(at):
        end = out[-1][1] if out else 0
        if out and b + REACH <= end:
            continue  # it lies in the last stretch; so no part of a text is searched twice
        a = max(text.rfind(c, end, max(0, a - REACH)) for c in (" ", "\n")) + 1
        b = min(x if x >= 0 else len(text) for x in (text.find(" ", b + REACH), text.find("\n", b + REACH)))
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _word_pattern(name: str) -> str:
    """The name as a whole word, or anywhere if its script has no spaces between words."""
    whole = re.escape(name)
    return whole if all(unicodedata.name(c, "").startswith(UNSPACED) for c in name) else rf"(?<!\w){whole}(?![\w{MARKS}])"


def entities(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of each entity in order, from one place to the next.

    Kinds: email, token, awskey, secret, iban, ip6, ip, phone, ssn, card, person. Names come without their titles, each word on its own, and wherever else the words of a name stand in the text. A name is what follows a title,
    a known given name before another name, or two capitalised words before a verb of speech; initials are left. Card numbers are those whose check digit holds.
    """
    found = []
    names = set()
    for m in (m for a, b in _near(text) for m in PATTERNS.finditer(text, a, b)):
        if m.lastgroup in ("person", "known", "speaker"):
            names |= {n for n in re.findall(f"{LETTER}{{2,}}", m[0].split(" ", 1)[1] if m.lastgroup == "person" else m[0]) if n not in TITLES}
        elif (m.lastgroup != "card" or luhn(m[0])) and (m.lastgroup != "ip6" or _addressed(m[0])):
            found.append((m.start(), m.end(), m.lastgroup))
    if names:
        taken = [False] * (len(text) + 1)
        for a, b, _ in found:
            taken[a:b] = [True] * (b - a)
        found += [(m.start(), m.end(), "person") for m in re.finditer("|".join(_word_pattern(n) for n in sorted(names, key=lambda n: (-len(n), n))), text) if not any(taken[m.start() : m.end()])]
    return sorted(found)


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and kind, original, surrogate of each entity in order."""
    out, at, told = [], 0, []
    for a, b, kind in entities(text):
        made = surrogate(kind, text[a:b], key)
        out += [text[at:a], made]
        told.append((kind, text[a:b], made))
        at = b
    return "".join([*out, text[at:]]), told


def _key(secret: str) -> bytes:
    return hashlib.blake2b(secret.encode(), digest_size=32).digest()


def replace_entities(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text with surrogates, kinds (of its entities, in order): one row for each document, in one pass without a shuffle.

    Defined cases: a null text stays null, with no kinds; texts without entities are unchanged; equal entities get equal surrogates in any row; other columns are left
    out; an empty table gives no rows.
    """
    key, kind = _key(secret), modest_batches(docs).schema[id_col].dataType.simpleString()

    def apply(batches):
        for batch in sliced(batches):
            made = [(None, []) if t is None else replaced(t, key) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in made], pa.string()), pa.array([[k for k, _, _ in told] for _, told in made], pa.list_(pa.string()))], [id_col, "text", "kinds"])

    return docs.select(id_col, text_col).mapInArrow(apply, f"`{id_col}` {kind}, text string, kinds array<string>")


def canonical(kind: str, text: str) -> str:
    """What two mentions of one entity share."""
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "ip6":
        return ipaddress.IPv6Address(text).compressed
    return text.lower() if kind == "email" else "".join(c for c in text if c.isalnum()) if kind in ("phone", "card", "ssn", "iban") else text


def entity_table(docs: DataFrame, secret: str, text_col: str = "text") -> DataFrame:
    """kind, original, surrogate, mentions: the corpus's entities, counted within tasks first."""
    key = _key(secret)

    def tell(batches):
        for batch in sliced(batches):
            rows = [(k, canonical(k, a), canonical(k, b)) for t in batch.column(0).to_pylist() if t for k, a, b in replaced(t, key)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "original", "surrogate"])

    return docs.select(text_col).mapInArrow(tell, "kind string, original string, surrogate string").groupBy("kind", "original", "surrogate").agg(F.count(F.lit(1)).alias("mentions"))


def collisions(table: DataFrame) -> DataFrame:
    """Entities whose surrogate another entity of the kind has too, or that have more than one, or are their own: none should be."""
    by_surrogate = table.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("original").alias("original")).where("n > 1")
    by_original = table.groupBy("kind", "original").agg(F.count(F.lit(1)).alias("n"), F.min("surrogate").alias("surrogate")).where("n > 1")
    same = table.where("original = surrogate").select("kind", "surrogate", F.lit(1).cast("long").alias("n"), "original")
    return by_surrogate.unionByName(by_original).unionByName(same)


def run_key(spark) -> str:
    """The caller's key: spark.lociflow.pii.key, or the environment's LOCIFLOW_PII_KEY; where neither is set, a new random one, so that surrogates agree within a run only."""
    return spark.conf.get("spark.lociflow.pii.key", None) or os.environ.get("LOCIFLOW_PII_KEY") or secrets.token_hex(32)


def op10_pii_surrogates(spark, sf_dir: str, secret: str | None = None) -> DataFrame:
    """All documents with surrogates for their entities: doc_id, text, kinds, n_entities; raises if two entities share a surrogate. `secret`: see run_key()."""
    docs, secret = spark.read.parquet(f"{sf_dir}/documents.parquet"), secret or run_key(spark)
    table = written(entity_table(docs, secret), "entities")
    if bad := collisions(table).take(3):
        raise ValueError(f"surrogates are not distinct: {[(b['kind'], b['n']) for b in bad]}")
    drop_written(table)
    return replace_entities(docs, secret).withColumn("n_entities", F.size("kinds"))
