"""Surrogates for personal data: keyed, of the same type and format, distinct where the originals are.

A surrogate is the original under a keyed permutation of all strings of its format: vowels stay vowels,
consonants consonants, digits digits, capitals capitals, letters of a script letters of that script, and
what is neither stays. The same entity therefore has the same surrogate everywhere (coreference), and
two entities never share one (distinctness), without a table of either. Given names that are known
move within the names of their gender and script; others keep their format and end as names of their gender do,
which a title in the text tells, or else the name's own ending. That no two entities share a surrogate and no entity
has two is checked by Spark aggregations over the distinct pairs.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

ROUNDS = 8
VOWELS, CONSONANTS, DIGITS = "aeiouy", "bcdfghjklmnpqrstvwxz", "0123456789"

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Julia Laura Sarah Emma Clara Sofia Elena Marta Lucia Carmen Claire Camille Louise Helen Alice Susan Karen Ingrid Heike Petra Monika Nora".split(),
    ("latin", "m"): "John Peter Paul Thomas Martin David Daniel Robert Andreas Stefan Klaus Jean Pierre Michel Luc Carlos Miguel Antonio Javier Diego George Henry James Oliver".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία".split(),
    ("greek", "m"): "Γιώργος Νίκος Γιάννης Δημήτρης".split(),
}
#: Titles before a name, by gender.
TITLES = {"m": "Mr Mister Herr Monsieur Señor Господин Κύριος".split(), "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Госпожа Κυρία".split(), "": "Dr Prof".split()}

EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]*[\w+-]@(?:[\w-]+\.)+[A-Za-z]{2,24}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
IPV4 = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")
IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,5}){0,4}(?!\w)")
DATE = re.compile(r"(?:\d{4}[-.]\d\d?[-.]\d\d?|\d\d?[-.]\d\d?[-.]\d{4})\Z")
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
#: What stands before a person's name, in four languages.
CUES = (
    "[Mm]y name is|I am called|[Ss]igned(?: by)?:?|Sincerely,|[Rr]egards,|Dear|Attn:?|[Cc]ontact(?: person)?:?|(?:[Ff]ull )?[Nn]ame:|Patient:|Customer:|Employee:|Author:|Applicant:|"
    "[Ii]ch heiße|[Mm]ein Name ist|Liebe|Lieber|Ansprechpartner(?:in)?:?|Kunde:|Kundin:|[Jj]e m'appelle|[Mm]on nom est|Chère|Cher|[Mm]e llamo|[Mm]i nombre es|Querida|Querido|Estimada|Estimado|Nombre:|Nom:"
)
TITLED = re.compile(rf"(?<!\w)({'|'.join(t for ts in TITLES.values() for t in ts)})(\.?) ({_WORD})(?: ({_WORD}))?")
#: Words that follow such cues and are no names.
NO_NAMES = frozenset("Sir Madam Customer Customers Hiring Valued Team Colleague Colleagues Editor Friend Friends Reader Readers All Damen Herren Kunde Kunden Kollegen Clients Clientes".split())
CUED = re.compile(rf"(?<!\w)(?:{CUES})\s+({_WORD}) ({_WORD})(?!\w)")
ADDRESSED = re.compile(rf"(?<!\w)({_WORD}) ({_WORD}),? ?[<(](?=[\w.+-]+@[\w-]+\.)")
NAMED = re.compile(rf"(?<!\w)({'|'.join(n for ns in GIVEN.values() for n in ns)}) ({_WORD})")

GENDER = {t: g for g, ts in TITLES.items() for t in ts}
POOL = {n: key for key, names in GIVEN.items() for n in names}
#: Letters that feminine given names mostly end with, and the ending that a surrogate gets, by script and gender.
FEMININE = "aeiyаяαη"
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "o", ("cyrillic", "f"): "а", ("cyrillic", "m"): "й", ("greek", "f"): "α", ("greek", "m"): "ς"}
#: Calling codes of one and of two digits; all others have three.
CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


@lru_cache(200_000)
def _alphabet(ch: str) -> str | None:
    """The characters that ``ch`` may turn into; None if it stays."""
    low = ch.lower()
    for letters in (VOWELS, CONSONANTS):
        if ch in letters:
            return letters
        if low in letters and len(low) == 1:
            return letters.upper()
    if ch in DIGITS:
        return DIGITS
    kind = unicodedata.category(ch)
    if kind[0] != "L" and kind != "Nd":
        return None
    at = ord(ch) // 128 * 128
    return _block(at, kind)


@lru_cache(4_096)
def _block(at: int, kind: str) -> str:
    return "".join(c for c in map(chr, range(at, at + 128)) if unicodedata.category(c) == kind)


def _noise(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=48).digest(), "big")


def permute(text: str, key: bytes, tweak: str, alphabets: list[str | None] | None = None) -> str:
    """``text`` under a keyed permutation of all texts of its format: a Feistel network on the two halves of
    its characters, read as numbers of mixed radix. Texts of other formats have other outputs by themselves.
    """
    alphabets = alphabets or [_alphabet(c) for c in text]
    places = [i for i, a in enumerate(alphabets) if a and len(a) > 1]
    if not places:
        return text
    shape = "".join(c if a is None or len(a) < 2 else f"\x00{ord(a[0])}\x00" for c, a in zip(text, alphabets, strict=True))
    halves = [places[: len(places) // 2], places[len(places) // 2 :]]
    sizes, values = [1, 1], [0, 0]
    for h in (0, 1):
        for i in halves[h]:
            values[h] = values[h] * len(alphabets[i]) + alphabets[i].index(text[i])
            sizes[h] *= len(alphabets[i])
    for r in range(ROUNDS):
        h = r % 2
        noise, bits = 0, max(1, sizes[h].bit_length() // 256 + 1)
        for k in range(bits):
            noise = noise << 384 | _noise(key, tweak, shape, r, k, values[1 - h])
        values[h] = (values[h] + noise) % sizes[h]
    out = list(text)
    for h in (0, 1):
        v = values[h]
        for i in reversed(halves[h]):
            v, d = divmod(v, len(alphabets[i]))
            out[i] = alphabets[i][d]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit for ``digits``."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 - k % 2)
        total += x - 9 * (x > 9)
    return -total % 10


def _spread(digits: str, model: str) -> str:
    """``digits`` in the places of the alphanumeric characters of ``model``."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in model)


def card(text: str, key: bytes) -> str:
    """First digit and spacing stay; the new number fits its check digit exactly if the old one did."""
    d = re.sub(r"\D", "", text)
    inner = d[0] + permute(d[1:-1], key, "card" + d[0])
    return _spread(inner + str((luhn(inner) + int(d[-1]) - luhn(d[:-1])) % 10), text)


def phone(text: str, key: bytes) -> str:
    """The country code and all but digits stay. The code is told by the digits alone, however they are spaced."""
    d = re.sub(r"\D", "", text)
    head = next((d[:n] for n in (1, 2) if d[:n] in CODES), d[:3]) if text.startswith("+") else ""
    return _spread(head + permute(d[len(head) :], key, "phone" + head), text)


def _range_of(ip: int) -> str:
    a = ipaddress.IPv4Address(ip)
    return "loopback" if a.is_loopback else "private" if a.is_private else "multicast" if a.is_multicast else "reserved" if a.is_reserved or a.is_unspecified else "public"


def ipv4(text: str, key: bytes) -> str:
    """An address of the same range: private ones stay private."""
    ip = int(ipaddress.IPv4Address(".".join(str(int(x)) for x in text.split("."))))
    kind, half = _range_of(ip), [0, 0]
    for _ in range(100_000):
        half = [ip >> 16, ip & 0xFFFF]
        for r in range(ROUNDS):
            half[r % 2] = (half[r % 2] + _noise(key, "ipv4", r, half[1 - r % 2])) & 0xFFFF
        ip = half[0] << 16 | half[1]
        if _range_of(ip) == kind:  # walking on until the range fits keeps it a permutation
            break
    return str(ipaddress.IPv4Address(ip))


def email(text: str, key: bytes) -> str:
    """Both parts keep their format. The last label of the domain stays, and reserved example domains do."""
    local, domain = text.lower().rsplit("@", 1)
    labels = domain.split(".")
    fixed = 2 if len(labels) > 1 and labels[-2] == "example" else 1
    return f"{permute(local, key, 'local')}@{'.'.join([permute(x, key, 'label') for x in labels[:-fixed]] + labels[-fixed:])}"


def iban(text: str, key: bytes) -> str:
    """The country stays, the check digits are made to fit."""
    d = text.replace(" ", "")
    inner = permute(d[4:], key, "iban" + d[:2])
    rest = int("".join(str(int(c, 36)) for c in inner + d[:2] + "00")) % 97
    was = int("".join(str(int(c, 36)) for c in d[4:] + d[:2] + "00")) % 97
    check = (98 - rest + int(d[2:4]) - (98 - was)) % 100
    return _spread(d[:2] + f"{check:02d}" + inner, text)


def ipv6(text: str, key: bytes) -> str:
    return permute(text.lower(), key, "ipv6", ["0123456789abcdef" if c != ":" else None for c in text])


def family(text: str, key: bytes) -> str:
    return permute(text, key, "family")


def script(text: str) -> str:
    name = unicodedata.name(text[0], "LATIN").split()[0].lower()
    return name if name in ("cyrillic", "greek") else "latin"


def gender_of(name: str, told: str = "") -> str:
    """Of a known name its own; else what a title told, or what the name's ending makes likely."""
    return POOL[name][1] if name in POOL else told or ("f" if name[-1].lower() in FEMININE else "m")


def given(text: str, key: bytes, gender: str = "") -> str:
    """A known name turns into another of its gender and script; others keep their format, get their gender's ending
    and stay unknown. Within a gender and script no two names share a surrogate, as the ending is the same."""
    if text in POOL:
        names = sorted(GIVEN[POOL[text]], key=lambda n: _noise(key, "given", n))
        return names[(names.index(text) + 1) % len(names)]
    out, ending = permute(text, key, "given"), ENDINGS[script(text), gender_of(text, gender)]
    while out + ending in POOL:
        out = permute(out, key, "given")
    return out + ending


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    stop: int
    surrogate: str
    entity: str
    #: How mentions of the surrogate are told to be the same.
    stands: str


#: What makes a surrogate of a mention; the names of a person also hang on the gender.
MAKERS = {"email": email, "iban": iban, "ipv6": ipv6, "ipv4": ipv4, "card": card, "ssn": lambda t, k: permute(t, k, "ssn"), "phone": phone, "family": family, "given": given}


def _capital(word: str | None) -> bool:
    return bool(word) and word[0].isupper() and not word.isupper()


def _candidates(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, stop, gender that a title tells), the surer kinds first."""
    if "@" in text:
        yield from (("email", *m.span(), "") for m in EMAIL.finditer(text))
    if any(d in text for d in DIGITS):
        yield from (("iban", *m.span(), "") for m in IBAN.finditer(text))
        if ":" in text:
            yield from (("ipv6", *m.span(), "") for m in IPV6.finditer(text))
        yield from (("ipv4", *m.span(), "") for m in IPV4.finditer(text) if all(int(x) < 256 for x in m[0].split(".")))
        for m in CARD.finditer(text):
            d = re.sub(r"\D", "", m[0])
            if luhn(d[:-1]) == int(d[-1]) or d[0] in "3456" and len(d) in (15, 16) and not m[0].count("-") > 4:
                yield "card", *m.span(), ""
        yield from (("ssn", *m.span(), "") for m in SSN.finditer(text))
        for m in PHONE.finditer(text):
            n = sum(map(str.isdigit, m[0]))
            marked = m[0][0] in "+(" or n >= 10 and re.search(r"\d[ .-]\d", m[0])
            if marked and 7 <= n <= 15 and not DATE.match(m[0]):
                yield "phone", *m.span(), ""
    people: dict[tuple[str, str], str] = {}  # full names that something in the text marks, and the gender told of them
    alone: dict[str, str] = {}
    for m in TITLED.finditer(text):
        if _capital(m[3]):
            told = GENDER[m[1]]
            if _capital(m[4]):
                people[m[3], m[4]] = people.get((m[3], m[4])) or told
                alone[m[3]] = alone.get(m[3]) or told
            elif m[3] in POOL:
                yield "given", *m.span(3), ""
            else:
                yield "family", *m.span(3), ""
    for pattern in (CUED, ADDRESSED) if "@" in text else (CUED,):
        for m in pattern.finditer(text):
            if _capital(m[1]) and _capital(m[2]) and m[1] not in GENDER and m[1] not in NO_NAMES:
                people.setdefault((m[1], m[2]), "")
    # Wherever such a name stands in the text, it is the same person.
    if people:
        firsts = "|".join(map(re.escape, sorted({a for a, _ in people})))
        for m in re.finditer(rf"(?<!\w)({firsts}) ({_WORD})", text):
            if (m[1], m[2]) in people:
                yield "given", *m.span(1), alone.get(m[1], "")
                yield "family", *m.span(2), ""
    for m in NAMED.finditer(text):
        if _capital(m[2]):
            yield "given", *m.span(1), ""
            yield "family", *m.span(2), ""


def canonical(kind: str, text: str, gender: str = "") -> str:
    """How mentions of one entity are told to be the same. An unknown given name may be borne by both genders."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "phone":
        return re.sub(r"[^\d+]", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ipv4":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "given":
        return f"{text} ({gender_of(text, gender)})"
    return text.lower() if kind in ("email", "ipv6") else text


def find(text: str | None, key: bytes, memo: dict | None = None) -> list[Found]:
    """Entities of a whole text with their surrogates, in order, not overlapping; the first kind wins."""
    out, taken = [], bytearray(len(text or ""))
    for kind, a, b, gender in _candidates(text or ""):
        if taken.find(1, a, b) >= 0:
            continue
        taken[a:b] = b"\x01" * (b - a)
        part = text[a:b]
        at = (kind, part, gender)
        if memo is None or at not in memo:
            made = given(part, key, gender) if kind == "given" else MAKERS[kind](part, key)
            # The surrogate of a name has the gender that the name has.
            pair = (made, canonical(kind, part, gender), canonical(kind, made, gender_of(part, gender) if kind == "given" else ""))
            if memo is not None and len(memo) < 100_000:
                memo[at] = pair
        else:
            pair = memo[at]
        out.append(Found(kind, a, b, *pair))
    return sorted(out, key=lambda f: f.start)


REPLACED = "text string, found array<struct<kind:string,start:int,stop:int,entity:string,surrogate:string>>"


def replaced(text: Column, key: bytes) -> Column:
    """struct REPLACED of each whole text: its form with surrogates, and what was found in the original."""

    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for texts in batches:
            rows = []
            for t in texts:
                found = find(t, key, memo)
                at, parts = 0, []
                for f in found:
                    parts += [t[at : f.start], f.surrogate]
                    at = f.stop
                rows.append((t if not found else "".join([*parts, t[at:]]), [(f.kind, f.start, f.stop, f.entity, f.stands) for f in found]))
            yield pd.DataFrame(rows, columns=["text", "found"])

    return F.pandas_udf(replace, REPLACED)(text)


def anonymize(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``surrogate``: struct REPLACED of each whole text.

    Null texts stay null and have no entities, like empty ones. Rows are treated by themselves with one key, so
    repeated rows and mentions in other rows get equal surrogates. Very long texts cost in proportion to
    their length. A column of docs named surrogate is replaced.
    """
    return docs.withColumn("surrogate", replaced(F.col(text_col), key))


def _pairs(anonymized: DataFrame) -> DataFrame:
    """Mentions once per pair, before they meet, so that a frequent one makes no large group."""
    return anonymized.select(F.explode("surrogate.found").alias("f")).select("f.kind", "f.surrogate", "f.entity").distinct()


def collisions(anonymized: DataFrame) -> DataFrame:
    """(kind, surrogate, entities): surrogates that stand for more than one entity; none are expected."""
    return _pairs(anonymized).groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")


def splits(anonymized: DataFrame) -> DataFrame:
    """(kind, entity, surrogates): entities with more than one surrogate; none are expected."""
    return _pairs(anonymized).groupBy("kind", "entity").agg(F.count("*").alias("surrogates")).where("surrogates > 1")


def checked(docs: DataFrame, key: bytes, text_col: str = "text", most_keys: int = 4) -> DataFrame:
    """``anonymize`` with the first key, made from ``key``, under which no two entities share a surrogate.

    What is made under a key is written to the shared folder and checked there, so texts are searched once for each key.
    That an entity has two surrogates would be a fault of the makers, not of a key, and raises an error.
    """
    for n in range(most_keys):
        out = staged(anonymize(docs, hashlib.blake2b(b"%d" % n, key=key).digest(), text_col), "surrogates", "zstd")
        if not (split := splits(out)).isEmpty():
            raise ValueError(f"an entity has several surrogates: {split.first()}")
        if collisions(out).isEmpty():
            return out
    raise ValueError(f"entities share surrogates under {most_keys} keys")
