"""Format-preserving pseudonyms for personal data and secrets.

Recognised: card numbers (Luhn), IBANs (mod 97), US social security numbers, telephone
numbers, IPv4 and IPv6 addresses, calendar dates in digits or with an English, German, French or
Spanish month name, e-mail addresses, and secrets (hexadecimal tokens, access key ids, values with a
digit behind password=, token:, Bearer, sk- and the like). A large number written in groups of three
digits ("12 345 678") looks like a telephone number and is taken for one; four numbers behind
"version" or "v" are no address. A number or date counts only if it is valid. Where a card number or IBAN
that is matched fails its check, or meets what is recognised already, its shorter prefixes and
later starts at group boundaries are tried too; a telephone number is none where the same
separator joins it to further groups of digits. Ten digits without separators are no telephone
number, since ids look the same.

A value's digits become an integer below the number of values of its format; a keyed Feistel
network permutes that range (cycle walking keeps it inside), and the result is written in the
same format: same separators and, but for IP addresses and month names, the same length; check
digits computed anew, dates valid. An IPv4 address with leading zeros counts only if all its parts
have three digits, and stays so. Equal values get equal pseudonyms in every document, whatever
their separators, and whoever has the key can undo the permutation. (Where other groups of digits
stand beside a card, a longer or earlier number may pass the check by chance, before or after; a
new scan of the pseudonyms then cuts the groups otherwise than the first one did.)

The key is the text in the session's setting spark.tidemill.pii.secret. Where it is unset, the
session gets a random one, so that nobody can undo its pseudonyms; set it to keep values linked
across sessions.

Nothing else of a text changes. Null text stays null and empty text empty; repeated rows
are treated alike; an empty table gives an empty result; other columns are kept by
`pseudonymise`, whatever their names, and ignored by `pii_report`.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import tidy

KEY_SETTING = "spark.tidemill.pii.secret"
KEY = secrets.token_bytes(32)
"""For Pseudonyms made without a key: another one in each process."""
ROUNDS = 8


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, or a random one that it keeps."""
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        named = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, named)
    return hashlib.blake2b(named.encode(), digest_size=32).digest()


class Feistel:
    """A keyed permutation of range(size)."""

    def __init__(self, key: bytes, kind: str, size: int) -> None:
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.keys = [hashlib.blake2b(f"{kind}:{size}:{r}".encode(), key=key[:64], digest_size=32).digest() for r in range(ROUNDS)]

    def _f(self, r: int, x: int) -> int:
        data = x.to_bytes(self.half // 8 + 1, "little")
        return int.from_bytes(hashlib.blake2b(data, key=self.keys[r], digest_size=min(64, self.half // 8 + 8)).digest(), "little") & self.mask

    def forward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in range(ROUNDS):
                a, b = b, a ^ self._f(r, b)
            x = a << self.half | b
            if x < self.size:
                return x

    def backward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in reversed(range(ROUNDS)):
                a, b = b ^ self._f(r, a), a
            x = a << self.half | b
            if x < self.size:
                return x


@lru_cache(maxsize=4096)
def feistel(key: bytes, kind: str, size: int) -> Feistel:
    return Feistel(key, kind, size)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def refill(shape: str, digits: str) -> str:
    """digits in the places of shape's digits."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


class Pseudonyms:
    """Rewrites one value of each kind; `undo` turns the permutation round."""

    def __init__(self, key: bytes = KEY, undo: bool = False) -> None:
        self.key, self.undo = key, undo

    def permute(self, kind: str, size: int, x: int) -> int:
        f = feistel(self.key, kind, size)
        return f.backward(x) if self.undo else f.forward(x)

    def number(self, kind: str, digits: str) -> str:
        return str(self.permute(f"{kind}{len(digits)}", 10 ** len(digits), int(digits))).zfill(len(digits))

    def card(self, s: str) -> str | None:
        d = _digits(s)
        if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        body = self.number("card", d[:-1])
        return refill(s, body + luhn_digit(body))

    def iban(self, s: str) -> str | None:
        flat = s.replace(" ", "")
        if not 15 <= len(flat) <= 34 or int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 != 1:
            return None
        body = self.mixed("iban", flat[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + flat[:2] + "00")) % 97
        it = iter(flat[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(it) for c in s)

    def ssn(self, s: str) -> str | None:
        area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        x = self.permute("ssn", 898 * 99 * 9999, (areas.index(area) * 99 + group - 1) * 9999 + serial - 1)
        return f"{areas[x // 9999 // 99]:03d}{s[3]}{x // 9999 % 99 + 1:02d}{s[6]}{x % 9999 + 1:04d}"

    def phone(self, s: str) -> str | None:
        d = _digits(s)
        if not 7 <= len(d) <= 15:
            return None
        head, own = d[:-10] if len(d) > 10 else "", d[-10:]
        return refill(s, head + self.number("phone", own))

    def far_phone(self, s: str) -> str | None:
        return self.phone(s)

    def local_phone(self, s: str) -> str | None:
        """A number that begins with 0, which stays."""
        d = _digits(s)
        if not 9 <= len(d) <= 12:
            return None
        return refill(s, d[:-9] + self.number("phone0", d[-9:]) if len(d) > 9 else d[0] + self.number("phone0", d[1:]))

    def walk(self, kind: str, size: int, x: int, fits) -> int:
        """Permutes until the value fits; x itself must fit, so this permutes the values that do."""
        while True:
            x = self.permute(kind, size, x)
            if fits(x):
                return x

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if max(map(int, parts)) > 255:
            return None
        x = int.from_bytes(bytes(map(int, parts)), "big")
        if any(p[0] == "0" and len(p) > 1 for p in parts):
            if any(len(p) != 3 for p in parts):
                return None
            x = self.walk("ip000", 1 << 32, x, lambda v: min(v.to_bytes(4, "big")) < 100)
            return ".".join(f"{p:03d}" for p in x.to_bytes(4, "big"))
        return ".".join(map(str, self.permute("ip", 1 << 32, x).to_bytes(4, "big")))

    def ipv6(self, s: str) -> str | None:
        try:
            address = ipaddress.IPv6Address(s)
        except ValueError:
            return None
        new = ipaddress.IPv6Address(self.permute("ipv6", 1 << 128, int(address)))
        text = new.exploded if len(s) == 39 else new.compressed
        return text.upper() if s != s.lower() else text

    FIRST, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()

    def date(self, s: str) -> str | None:
        parts = re.split(r"[-/.]", s)
        sep = re.sub("[0-9]", "", s)
        order = "ymd" if len(parts[0]) == 4 else "dmy"
        if order == "dmy" and int(parts[1]) > 12:
            order = "mdy"
        y, m, d = (int(parts[order.index(c)]) for c in "ymd")
        try:
            day = datetime.date(y, m, d).toordinal() - self.FIRST
        except ValueError:
            return None
        if not 0 <= day < self.DAYS:
            return None
        # month first is read as such only where the day is above 12
        new = self._day(day, (lambda d: d.day > 12) if order == "mdy" else lambda d: True)
        value = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return value[order[0]] + sep[0] + value[order[1]] + sep[1] + value[order[2]]

    def short_date(self, s: str) -> str | None:
        """Day and month without leading zeros, one of them below 10; month first only where the day is above 12."""
        sep = re.sub("[0-9]", "", s)[0]
        first, second, y = map(int, s.split(sep))
        d, m = (second, first) if second > 12 else (first, second)
        try:
            day = datetime.date(y, m, d).toordinal() - self.FIRST
        except ValueError:
            return None
        if not 0 <= day < self.DAYS:
            return None
        if second > 12:
            new = self._day(day, lambda x: x.day > 12 and x.month < 10)
            return f"{new.month}{sep}{new.day}{sep}{new.year:04d}"
        new = self._day(day, lambda x: x.day < 10 or x.month < 10)
        return f"{new.day}{sep}{new.month}{sep}{new.year:04d}"

    def local_date(self, s: str) -> str | None:
        """A day, a month's name in German, French or Spanish, and a year."""
        d, name, y = _LOCAL_DATE.fullmatch(s).groups()
        names = next(n for n in LOCAL_MONTHS.values() if name in n)
        try:
            day = datetime.date(int(y), names.index(name) + 1, int(d)).toordinal() - self.FIRST
        except ValueError:
            return None
        if not 0 <= day < self.DAYS:
            return None
        new = self._day(day, lambda x: d[0] != "0" or x.day < 10)
        text = f"{new.day:02d}" if d[0] == "0" else str(new.day)
        return text + s[len(d) : -4].replace(name, names[new.month - 1]) + f"{new.year:04d}"

    def _day(self, day: int, fits) -> datetime.date:
        def at(x: int) -> datetime.date:
            return datetime.date.fromordinal(self.FIRST + x)

        return at(self.walk("date", self.DAYS, day, lambda x: fits(at(x))))

    def written_date(self, s: str) -> str | None:
        m = re.search("[A-Za-z]+", s)
        name = next((i for i, n in enumerate(MONTHS) if m[0] in (n, n[:3])), None)
        y, d = s[-4:], re.sub("[^0-9]", "", s[:-4])
        try:
            day = datetime.date(int(y), name + 1, int(d)).toordinal() - self.FIRST
        except ValueError:
            return None
        if not 0 <= day < self.DAYS:
            return None
        short, padded = m[0] != MONTHS[name], d[0] == "0"
        # May is read as a full name, and only days below 10 have a leading zero
        new = self._day(day, lambda x: not (short and x.month == 5 or padded and x.day > 9))
        month = MONTHS[new.month - 1][: 3 if short else None]
        day_text = f"{new.day:02d}" if padded else str(new.day)
        out = s[:-4].replace(m[0], "\0")
        return re.sub("[0-9]+", day_text, out).replace("\0", month) + f"{new.year:04d}"

    def mixed(self, kind: str, s: str) -> str:
        """Digits, small and capital letters (A-Z) permuted in their places; other characters stay."""
        radix = [10 if "0" <= c <= "9" else 26 if "a" <= c.lower() <= "z" else 1 for c in s]
        size = x = 1
        x = 0
        for c, r in zip(s, radix):
            if r > 1:
                x, size = x * r + (int(c) if r == 10 else ord(c.lower()) - 97), size * r
        if size == 1:
            return s
        x = self.permute(f"{kind}{''.join('d' if r == 10 else 'l' if r == 26 else '-' for r in radix)}", size, x)
        out = []
        for c, r in zip(reversed(s), reversed(radix)):
            if r > 1:
                x, v = divmod(x, r)
                c = str(v) if r == 10 else chr((97 if c.islower() else 65) + v)
            out.append(c)
        return "".join(reversed(out))

    def email(self, s: str) -> str | None:
        head, tail = s.rsplit(".", 1)
        return self.mixed("email", head) + "." + tail

    def named_secret(self, s: str) -> str | None:
        return self.secret(s)

    def token(self, s: str) -> str | None:
        return self.mixed("token", s)

    def secret(self, s: str) -> str | None:
        if re.fullmatch("[0-9a-f]{16,}|[0-9A-F]{16,}", s):
            if s.isdigit() or s.isalpha():
                return self.mixed("secret", s)
            out = f"{self.permute(f'hex{len(s)}', 16 ** len(s), int(s, 16)):0{len(s)}x}"
            return out.upper() if s.isupper() else out
        return self.mixed("secret", s)

    def key_id(self, s: str) -> str | None:
        return s[:4] + self.mixed("key", s[4:])


#: English month names.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "(?:" + "|".join(f"{n}|{n[:3]}" for n in MONTHS) + ")"

#: Month names as they are written within a date of each language.
LOCAL_MONTHS = {
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
}
_DE, _FR, _ES = ("|".join(LOCAL_MONTHS[x]) for x in ("de", "fr", "es"))
#: Day, name and year of a written date: with a full stop, plain, or with "de".
_LOCAL_DATE = re.compile(rf"([0-9]{{1,2}})(?:\. | de | )({_DE}|{_FR}|{_ES})(?: de)? ([0-9]{{4}})")
_LOCAL = rf"[0-9]{{1,2}}\. (?:{_DE}) [0-9]{{4}}|[0-9]{{1,2}} (?:{_FR}) [0-9]{{4}}|[0-9]{{1,2}} de (?:{_ES}) de [0-9]{{4}}"

#: What is recognised, by kind, in order of precedence. A lookbehind keeps a match from starting inside a word or number.
PATTERNS = (
    ("email", r"[\w.%+-]{1,64}@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?<=[=:]\s)[\"']?(?=[0-9A-Za-z]*[0-9])[0-9A-Za-z_-]{16,}|(?<=[=:])[\"']?(?=[0-9A-Za-z]*[0-9])[0-9A-Za-z_-]{16,}|(?<![0-9A-Za-z])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}(?![0-9A-Za-z])"),
    ("named_secret", r"(?i)\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key)[\"']?\s?[:=]\s?[\"']?(?P<v>(?=[^\s\"',;<>]*[0-9])[^\s\"',;<>]{6,64})"),
    ("token", r"(?<![0-9A-Za-z_-])(?:sk|pk|rk|ghp|gho|glpat|xox[abp])[-_](?P<v>(?=[0-9A-Za-z_-]*[0-9])[0-9A-Za-z_-]{12,})|\b[Bb]earer (?P<w>(?=[0-9A-Za-z._~+/-]*[0-9])[0-9A-Za-z._~+/-]{12,})"),
    ("key_id", r"(?<![0-9A-Za-z])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?![0-9A-Za-z])"),
    ("date", r"(?<![0-9.-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9])"),
    ("short_date", r"(?<![0-9./-])(?:[1-9]([./])(?:[1-9]|[12][0-9]|3[01])|(?:[12][0-9]|3[01])([./])[1-9])(?:(?(1)\1|\2))[0-9]{4}(?![0-9])"),
    ("local_date", rf"(?<![0-9A-Za-z])(?:{_LOCAL})(?![0-9])"),
    ("written_date", rf"(?<![0-9A-Za-z])(?:[0-9]{{1,2}} {_MONTH},? [0-9]{{4}}|{_MONTH} [0-9]{{1,2}}, [0-9]{{4}})(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("ip", r"(?<![0-9.])(?<![Vv]ersion )(?<![Vv]ersión )(?<!\bv)(?<!\bV)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])"),
    ("ipv6", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)(?:[0-9a-f]{1,4}:|:|[0-9A-F]{1,4}:){2,7}(?:[0-9a-f]{1,4}|[0-9A-F]{1,4})(?![0-9A-Za-z:.])"),
    ("card", r"(?<![0-9A-Za-z+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?P<s>[ .-])[0-9]{3,4}(?P<t>[ .-])[0-9]{3,4}(?!(?P=t)[0-9]{3}|[0-9])|(?<![0-9A-Za-z])\+[0-9]{9,15}(?![0-9])"),
    # country, area and a number of two groups at most; and within a country with 0 first: area and number, or pairs
    ("far_phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-](?:\([0-9]{1,4}\)|[0-9]{1,4})[ ./-][0-9]{3,8}(?:[ .-][0-9]{1,5})?(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-][0-9]{1,3}(?:[ .-][0-9]{2}){3,4}(?![0-9])"),
    ("local_phone", r"(?<![0-9A-Za-z+./-])(?:0[0-9]{1,4}(?:/| / )[0-9]{4,9}|\(0[0-9]{1,4}\) ?[0-9]{4,9}|0[0-9](?:[ .][0-9]{2}){4})(?![0-9./-]*[0-9])"),
)
#: Kinds that are counted as another.
_AS = {"named_secret": "secret", "token": "secret", "written_date": "date", "short_date": "date", "local_date": "date", "far_phone": "phone", "local_phone": "phone"}
_COMPILED = [(k, re.compile(p)) for k, p in PATTERNS]
#: Kinds whose matches may take in neighbours, and where a match can end early.
_GROUPED = {"card": re.compile("[ -]"), "iban": re.compile(" ")}
#: What a text must hold for a match of the kind.
_NEEDS = {"email": "@", "ipv6": ":"}
_GROUP = re.compile("[0-9A-Za-z]+")
#: Digits in groups of four or more, the last of any size: parts of a match that count as a card before phones are looked for. Parts in other groups come after phones.
_CARD_GROUPS = re.compile("(?:[0-9]{4,}[ -])*[0-9]+")
_PASSES = [(k, p, k != "card") for k, p in _COMPILED] + [(k, p, True) for k, p in _COMPILED if k == "card"]
#: Groups that hold a value where the pattern also has what stands before it.
_VALUES = ("v", "w")
#: Three digits up to a place.
_DIGITS_BEFORE = re.compile("[0-9]{3}$")
_MAY = re.compile("[0-9@]")


def rewrite(text: str, pseudonyms: Pseudonyms) -> tuple[str, Counter]:
    """The text with pseudonyms, and how many values of each kind it had."""
    found: Counter = Counter()
    if not _MAY.search(text):
        return text, found
    spans: list[tuple[int, int, str, str]] = []
    for kind, pattern, parts in _PASSES:
        if (needed := _NEEDS.get(kind)) and needed not in text:
            continue
        at = behind = 0  # behind: the end of the last match that began behind the one before
        while m := pattern.search(text, at):
            a, b = m.span(next((g for g in _VALUES if g in pattern.groupindex and m[g] is not None), 0))
            at = b
            if kind == "phone" and m["s"] and a and text[a - 1] == m["s"] and _DIGITS_BEFORE.search(text, max(0, a - 4), a - 1):
                continue
            whole = a >= behind
            behind = b if whole else behind
            while b > a and text[a] in "\"'":
                a += 1
            ends = [b]
            if kind in _GROUPED:
                ends += [a + x.start() for x in _GROUPED[kind].finditer(text[a:b])][::-1]
                at = _GROUP.match(text, a).end()
            for end in ends:
                if any(a < y and x < end for x, y, _, _ in spans):
                    continue
                if not (parts or whole and end == b or _CARD_GROUPS.fullmatch(text, a, end)):
                    continue
                new = getattr(pseudonyms, kind)(text[a:end])
                if new is not None:
                    spans.append((a, end, kind, new))
                    found[_AS.get(kind, kind)] += 1
                    at = end
                    break
    if not spans:
        return text, found
    out, at = [], 0
    for a, b, _, new in sorted(spans):
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], found


def pseudonymise(docs: DataFrame, key: bytes | None = None, undo: bool = False, counts: bool = False) -> DataFrame:
    """docs with the text's personal data replaced; with counts, also n_found and kinds ("card:1 email:2"). key: the session's where None."""
    key = session_key(docs.sparkSession) if key is None else key
    i = docs.columns.index("text")
    schema = docs.schema
    if counts:
        schema = StructType([*schema.fields, StructField("n_found", LongType()), StructField("kinds", StringType())])
    names = schema.names

    def run(batches):
        p = Pseudonyms(key, undo)
        for batch in (b.slice(j, 512) for b in batches for j in range(0, len(b), 512)):
            texts, n, kinds = [], [], []
            for t in batch.column(i).to_pylist():
                new, found = (None, Counter()) if t is None else rewrite(t, p)
                texts.append(new)
                n.append(sum(found.values()))
                kinds.append(" ".join(f"{k}:{found[k]}" for k in sorted(found)))
            arrays = [pa.array(texts, pa.string()) if j == i else c for j, c in enumerate(batch.columns)]
            if counts:
                arrays += [pa.array(n, pa.int64()), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(tidy(run), schema)


def pii_report(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """Per document: doc_id, text (with pseudonyms), n_found, kinds."""
    return pseudonymise(docs.select("doc_id", "text"), key, counts=True)
