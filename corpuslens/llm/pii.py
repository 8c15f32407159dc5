"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

A value that passes its check (Luhn, calendar, octet range, ...) is replaced by another valid value of the same format.
The permutation depends on the key and the kind only, so equal values get equal pseudonyms in all documents, whatever
their punctuation, and different values stay different.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session setting that holds the key.
KEY_SETTING = "spark.corpuslens.pii.key"
ROUNDS = 8
KINDS = ("email", "phone", "ipv4", "card", "ssn", "iban", "date", "secret")
_FIRST, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def permute(x: int, n: int, tweak: bytes, key: bytes) -> int:
    """A keyed permutation of 0..n-1: balanced Feistel rounds over the next even number of bits, walked back into range."""
    if n < 2:
        return x
    half = ((n - 1).bit_length() + 1) // 2
    mask, size = (1 << half) - 1, (half + 7) // 8
    while True:
        a, b = x >> half, x & mask
        for r in range(ROUNDS):
            f = hashlib.shake_256(key + b"|" + tweak + bytes([r]) + b.to_bytes(size, "big")).digest(size)
            a, b = b, a ^ (int.from_bytes(f, "big") & mask)
        x = a << half | b
        if x < n:
            return x


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def luhn(payload: str) -> str:
    """Check digit of a payload."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        v = int(c) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return str(-total % 10)


def _card(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != d[-1]:
        return None
    n = len(d) - 1
    p = str(permute(int(d[:-1]), 10**n, b"card%d" % n, key)).zfill(n)
    return _refill(s, p + luhn(p))


def _phone(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not 10 <= len(d) <= 15:
        return None
    head = d[: len(d) - 10]  # the country code stays; numbers without one are linked to those of code 1
    return _refill(s, head + str(permute(int(d[-10:]), 10**10, b"phone" + (b"" if head == "1" else head.encode()), key)).zfill(10))


def _ipv4(s: str, key: bytes) -> str | None:
    octets = [int(x) for x in s.split(".")]
    if any(x > 255 for x in octets):
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ipv4", key).to_bytes(4, "big")))


def _valid_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not _valid_ssn(d):
        return None
    while True:
        d = str(permute(int(d), 10**9, b"ssn", key)).zfill(9)
        if _valid_ssn(d):
            return _refill(s, d)


def _by_class(s: str, tweak: bytes, key: bytes) -> str:
    """ASCII digits and letters permuted together, each within its class; the rest stays."""
    sets = [("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) if c.isalpha() else None for c in (c if c.isascii() else " " for c in s)]
    x, n = 0, 1
    for c, k in zip(s, sets):
        if k:
            x, n = x * k[1] + ord(c) - ord(k[0]), n * k[1]
    x = permute(x, n, tweak + str(n).encode(), key)
    out = []
    for c, k in zip(reversed(s), reversed(sets)):
        if k:
            x, v = divmod(x, k[1])
            c = chr(ord(k[0]) + v)
        out.append(c)
    return "".join(reversed(out))


def _secret(s: str, key: bytes) -> str:
    if re.fullmatch("[0-9a-f]+", s):
        return f"{permute(int(s, 16), 16 ** len(s), b'hex%d' % len(s), key):0{len(s)}x}"
    return _by_class(s, b"secret", key)


def _iban_check(bban: str, country: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in bban + country + '00')) % 97:02d}"


def _iban(s: str, key: bytes) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _iban_check(flat[4:], flat[:2]) != flat[2:4]:
        return None
    bban = _by_class(flat[4:], b"iban", key)
    it = iter(flat[:2] + _iban_check(bban, flat[:2]) + bban)
    return "".join(c if c == " " else next(it) for c in s)


def _date(s: str, key: bytes) -> str | None:
    a, b, c = re.split(r"[-/.]", s)
    year_first = len(a) == 4
    orders = [(a, b, c)] if year_first else [(c, a, b), (c, b, a)] if "/" in s else [(c, b, a)]
    for i, (y, m, d) in enumerate(orders):
        try:
            day = datetime.date(int(y), int(m), int(d))
        except ValueError:
            continue
        if not 0 <= (day - _FIRST).days < _DAYS:
            return None
        new = _FIRST + datetime.timedelta(permute((day - _FIRST).days, _DAYS, b"date", key))
        sep = re.search(r"[-/.]", s)[0]
        y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        return sep.join((y, m, d) if year_first else (m, d, y) if "/" in s and i == 0 else (d, m, y))
    return None


def _email(s: str, key: bytes) -> str | None:
    """The host stays (in lower case it is part of the tweak), so that a host's people stay apart from another's."""
    name, _, host = s.rpartition("@")
    return _by_class(name, b"email" + host.lower().encode(), key) + "@" + host


#: A run of a name's characters is tried once, from its start (possessively), so time is linear in the text.
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([._%+-]*+)([A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")
_SECRET = re.compile(r"""(?i)((?:token|secret|api[_-]?key|password|passwd|access[_-]?key)\s*[:=]\s*["']?)([A-Za-z0-9+/_-]{16,})""")
_NUMBER = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<ipv4>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"
    r"|(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"
    r")"
)
_NUMBERS = {"iban": _iban, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "card": _card, "phone": _phone}
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"\w+|\W")


def _cards_in(s: str, key: bytes) -> tuple[str, str] | None:
    """The longest run of whole digit groups at the start of s, shorter than s, that is a valid card; and its pseudonym."""
    for m in reversed(list(re.finditer("[ -]", s))):
        new = _card(s[: m.start()], key)
        if new is not None:
            return s[: m.start()], new
    return None


def _numbers(t: str, key: bytes, put) -> str:
    """t with its numbers replaced. Behind a match that fails its check the search goes on at its second group of digits."""
    out, done, at = [], 0, 0
    while m := _NUMBER.search(t, at):
        kind, old = m.lastgroup, m[0]
        new = _NUMBERS[kind](old, key)
        if new is None and kind == "card" and (found := _cards_in(old, key)):
            old, new = found
        if new is None:
            at = _GROUP.match(t, m.start()).end()
            continue
        out += [t[done : m.start()], put(kind, old, new)]
        done = at = m.start() + len(old)
    return "".join([*out, t[done:]])


def pseudonymize_text(t: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with its personal data replaced, and how often by kind."""
    n: dict[str, int] = {}

    def put(kind: str, old: str, new: str | None) -> str:
        if new is None:
            return old
        n[kind] = n.get(kind, 0) + 1
        return new

    if "@" in t:
        t = _EMAIL.sub(lambda m: m[1] + put("email", m[2], _email(m[2], key)), t)
    if "=" in t or ":" in t:
        t = _SECRET.sub(lambda m: m[1] + put("secret", m[2], _secret(m[2], key)), t)
    if _DIGIT.search(t):
        t = _numbers(t, key, put)
    return t, n


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's setting KEY_SETTING; where there is none, a random one that is kept there, so that values are linked within the session only."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return found.encode()


def pseudonymize(docs: DataFrame, text: str = "text", key: bytes | None = None) -> DataFrame:
    """docs with `text` pseudonymized, plus pii: a struct of counts by kind (all 0 for a null or clean text, which stays as it is).

    key: else that of session_key(). A vectorised function of one column: no shuffle, other columns don't leave the JVM and
    keep their values, whatever their names and types (null or repeated ids too); a column named pii is replaced. Texts are
    taken whole, in time linear in their length.
    """
    schema, key = f"text string, {', '.join(f'{k} long' for k in KINDS)}", key or session_key(docs.sparkSession)

    @F.pandas_udf(schema)
    def run(texts):
        import pandas as pd

        rows = [(t, {}) if t is None else pseudonymize_text(t, key) for t in texts]
        return pd.DataFrame({"text": [r[0] for r in rows]} | {k: [r[1].get(k, 0) for r in rows] for k in KINDS})

    name = "pii_of_text"
    while name in docs.columns:
        name += "_"
    done = docs.withColumn(name, run(F.col(text)))
    return done.withColumn(text, F.col(f"{name}.text")).withColumn("pii", F.struct(*(F.col(f"{name}.{k}").alias(k) for k in KINDS))).drop(name)


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, the pseudonymized text and the counts by kind."""
    return pseudonymize(docs.select("doc_id", "text")).select("doc_id", "text", *(F.col(f"pii.{k}").alias(f"n_{k}") for k in KINDS))
