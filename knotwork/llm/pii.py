"""Operator 1: format-preserving Feistel pseudonyms for personal data, with DataFrame functions only.

First the valid cards (Luhn) and IBANs (mod 97) of a text are found, at every position and every length that ends with a
group of characters. Then one regular expression finds values from left to right: these, and the other kinds, whose
patterns hold their ranges and the calendar, so that no span is skipped for a value that turns out invalid. Valid values
are replaced by a keyed permutation of their format, so equal values map to equal values everywhere, and different values
of one kind to different ones:

* text-shaped values (e-mail addresses, phone numbers, card payloads, secrets): the characters are split in two
  halves; each round adds to every character of one half, inside its own alphabet (digits, 2-9, a-z, A-Z), a keyed
  function of the other half. Check digits are computed anew.
* numeric values (dates, social security numbers, IPv4 addresses): x = a * B + b with a in [0, A) and b in [0, B), where
  A * B is the exact number of valid values, or, for days after a month's twelfth, slightly above it with cycle walking.

Linked spellings. Letters of e-mail addresses are permuted in lower case and get their case back. Phone numbers, cards and
IBANs are permuted without their separators, numbers with +1 or +49 like those with 001 or 0049. All formats of a date
share one permutation of days: 2001-02-03, 03.02.2001 and 03/02/2001 become one day. A date with slashes is dd/mm/yyyy,
or mm/dd/yyyy if the second number is above 12. The permutation keeps days up to the twelfth of a month among themselves,
since only later days have two spellings with slashes; so different dates with slashes stay different.

The keyed function is SHA-256 over key, kind, round and the other half. The key is an argument without default: whoever
knows it can invert every pseudonym.

Defined results. Null text stays null, other texts without a finding stay as they are, byte for byte. Values that
fail validation stay. Texts of any length are searched whole. Repeated rows give repeated results, an empty table an
empty one. Other columns, rows and their order are untouched; a column named like ``findings`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


def _days() -> str:
    """Exactly the dates from 1900-01-01 to 2099-12-31, in each format."""
    year, leap = "(?:19|20)[0-9]{2}", "(?:19(?:0[48]|[2468][048]|[13579][26])|20(?:0[048]|[2468][048]|[13579][26]))"
    days = [("(?:0[13578]|1[02])", "(?:0[1-9]|[12][0-9]|3[01])", year), ("(?:0[469]|11)", "(?:0[1-9]|[12][0-9]|30)", year), ("02", "(?:0[1-9]|1[0-9]|2[0-8])", year), ("02", "29", leap)]
    forms = [f"{y}-{m}-{d}|{d}/{m}/{y}|{m}/{d}/{y}|{d}\\.{m}\\.{y}" for m, d, y in days]
    return f"(?:{'|'.join(forms)})"


_DAY = _days()
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Dates may be joined by a slash or hyphen, as ends of a range.
_DATE = rf"{_DAY}(?![0-9]|[./\-](?!(?<=[/\-]){_DAY}(?![0-9]))[0-9])"
_SSN = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])"
_PHONE = r"(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .\-])[2-9][0-9]{2}[ .\-][0-9]{4}(?![0-9])"
#: Where a value of a fixed format begins after a separator, a card or an international number does not run on.
_OTHER = rf"(?!{_DATE}|{_SSN}|{_PHONE}|{_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9]))"
_CARD_AHEAD = r"(?![0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]|[0-9]{4}[ \-]?[0-9]{6}[ \-]?[0-9]{3})"
_INTL = r"(?:\)?(?:[ \-]%s(?=\(?[0-9]{2}))?\(?[0-9])"
#: 00 in place of a plus, if the country's number stands apart.
_ABROAD = r"(?:\+|00(?=[1-9][0-9]{0,2}[ \-]))"

#: The form of each kind, in order of preference at one position.
KINDS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?=[A-Za-z+/_.\-]*+[0-9])[A-Za-z0-9+/_.\-]{8,}+",
    "access_id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": rf"(?<![0-9])(?:(?<![./\-])|(?<=(?<![0-9./\-]){_DAY}[/\-])){_DATE}",
    "ssn": rf"(?<![0-9\-]){_SSN}",
    "phone": rf"(?<![0-9A-Za-z])(?:(?:\+|00)1[ .\-]?)?{_PHONE}",
    "intl_phone": rf"(?<![0-9A-Za-z]){_ABROAD}[1-9]{_INTL % ''}{{7,14}}\)?(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
}
#: The longest candidates of the kinds whose check sums no pattern can tell, at every position, also inside each other.
LONGEST = {
    "iban": rf"(?<![A-Za-z0-9])(?=({KINDS['iban'].removeprefix('(?<![A-Za-z0-9])')}))",
    "card": rf"(?<![0-9])(?=([0-9](?:[0-9]|[ \-]{_OTHER}[0-9]){{12,18}}(?![0-9])))",
}
#: What is searched for; cards and IBANs are searched for as the valid ones of a text. Other kinds are valid by form.
SEARCH = KINDS | {"intl_phone": rf"(?<![0-9A-Za-z]){_ABROAD}[1-9]{_INTL % ''}{{6}}{_INTL % (_OTHER + _CARD_AHEAD)}{{1,8}}\)?(?![0-9])"}
CANDIDATE = "|".join(v for k, v in SEARCH.items() if k not in LONGEST)
#: Every candidate holds one of these.
HINT = r"[0-9@]"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Years of valid dates.
YEARS = (1900, 2100)
#: Days up to the twelfth of a month: 200 years of 144 = 160 * 180. Later days: 200 years of 221 and 49 leap days, just below 210 * 211.
LOW_A, LOW_B, HIGH, HIGH_A, HIGH_B = 160, 180, 200 * 221 + 49, 210, 211
#: Later days of a year before each month, in common years.
HIGH_BEFORE = (0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202)
#: Valid area numbers (001-899 without 666) by valid groups and serials (01-99 by 0001-9999).
SSN_A, SSN_B = 898, 99 * 9999
#: IPv4 first octets 1-223 without 10 and 127, by 256, and 65536 lower addresses.
IP_A, IP_B = 221 * 256, 65536


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where the body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts], F.lit(key)), 256)


def feistel_number(x: Column, a: int, b: int, kind: str, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of [0, a * b)."""

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        other = F.when(even, s["b"]).otherwise(s["a"])
        f = F.conv(F.substring(_digest(key, F.lit(kind), r, other), 1, 14), 16, 10).cast("long")
        return F.struct(F.when(even, (s["a"] + f) % a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise((s["b"] + f) % b).alias("b"))

    start = F.struct(F.floor(x / b).cast("long").alias("a"), (x % b).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: s["a"] * b + s["b"])


def _shifted(text: Column, classes: Column, digest: Column) -> Column:
    return let(digest, lambda d: _moved(text, classes, d))


def _moved(text: Column, classes: Column, digest: Column) -> Column:
    """Each character moved inside its alphabet by two hex digits of the digest; class n: the digits 2-9."""

    def move(x: Column, at: Column) -> Column:
        c, k, i = x["c"], x["k"], at + 1
        by = F.conv(digest.substr((i - 1) * 2 % 62 + 1, F.lit(2)), 16, 10).cast("int") + i

        def inside(alphabet: str) -> Column:
            place = F.instr(F.lit(alphabet), c) - 1
            return F.lit(alphabet).substr((place + by) % len(alphabet) + 1, F.lit(1))

        return F.when(k == "d", inside(DIGITS)).when(k == "n", inside(DIGITS[2:])).when(k == "l", inside(LOWER)).when(k == "u", inside(UPPER)).otherwise(c)

    # split once, since reaching for a character by its place takes time with the place, and secrets may be long
    each = F.arrays_zip(F.split(text, "").alias("c"), F.split(classes, "").alias("k"))
    return F.when(F.length(text) > 0, F.concat_ws("", F.transform(each, move))).otherwise(text)


def feistel_text(text: Column, classes: Column, kind: str, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the texts whose characters have the given classes (d, n, l, u; others stay)."""
    return let(F.struct(text.alias("t"), classes.alias("c")), lambda v: _feistel_text(v["t"], v["c"], kind, key, rounds))


def _feistel_text(text: Column, classes: Column, kind: str, key: str, rounds: int) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    rest = F.length(text) - half
    ca, cb = classes.substr(F.lit(1), half), classes.substr(half + 1, rest)

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        a = F.when(even, _shifted(s["a"], ca, _digest(key, F.lit(kind), r, classes, s["b"]))).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(_shifted(s["b"], cb, _digest(key, F.lit(kind), r, classes, s["a"])))
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(text.substr(F.lit(1), half).alias("a"), text.substr(half + 1, rest).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def _classes(text: Column) -> Column:
    """Classes of characters: digits d, lower case l, upper case u, anything else x."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[^0-9A-Za-z]", "."), "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, chars: Column, slot: str) -> Column:
    """``shape`` with its characters that match ``slot`` replaced, in order, by those of ``chars``."""
    split = F.split(F.regexp_replace(shape, f"({slot})", "\x00"), "\x00", -1)
    return let(chars, lambda v: F.concat_ws("", F.transform(split, lambda p, i: F.concat(p, v.substr(i + 1, F.lit(1))))))


def luhn_sum(digits: Column, doubled_first_from_right: int) -> Column:
    """The Luhn sum; the digits at even (0) or odd (1) places from the right are doubled."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == doubled_first_from_right, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weight), F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)))


def _mod97(text: Column) -> Column:
    """An alphanumeric text as a number (A = 10 to Z = 35), modulo 97."""

    def step(s: Column, c: Column) -> Column:
        at = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return F.when(c == "", s).when(at < 10, (s * 10 + at) % 97).otherwise((s * 100 + at) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _email(m: Column, key: str) -> Column:
    """All but the top-level domain, without regard to case."""
    dot = F.length(m) - F.length(F.substring_index(m, ".", -1)) - 1
    head = m.substr(F.lit(1), dot)
    low = F.lower(head)
    cased = F.zip_with(F.split(feistel_text(low, _classes(low), "email", key), ""), F.split(head, ""), lambda n, o: F.when(o.rlike("[A-Z]"), F.upper(n)).otherwise(n))
    return F.concat(F.concat_ws("", cased), m.substr(dot + 1, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^([A-Za-z_\-]+[ \t]*[=:][ \t]*[\"']?)", 1)
    value = m.substr(F.length(name) + 1, F.length(m))
    return F.concat(name, feistel_text(value, _classes(value), "secret", key))


def _access_id(m: Column, key: str) -> Column:
    value = m.substr(F.lit(5), F.lit(16))
    return F.concat(m.substr(F.lit(1), F.lit(4)), feistel_text(value, _classes(value), "access_id", key))


def valid_iban(plain: Column) -> Column:
    body, front = plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4))
    return (F.length(plain) >= 15) & (F.length(plain) <= 34) & (_mod97(F.concat(body, front)) == 1)


def _iban(m: Column, key: str) -> Column:
    return let(F.regexp_replace(m, " ", ""), lambda plain: _plain_iban(m, plain, key))


def _plain_iban(m: Column, plain: Column, key: str) -> Column:
    country, body = plain.substr(F.lit(1), F.lit(2)), plain.substr(F.lit(5), F.length(plain))
    valid = valid_iban(plain)
    check = lambda new: F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, let(feistel_text(body, _classes(body), "iban", key), lambda new: _refill(m, F.concat(country, check(new), new), "[A-Z0-9]")))


def _leaps(year: Column) -> Column:
    """Leap years from 1900 to before this year (up to 2100)."""
    return F.greatest(F.floor((year - 1901) / 4), F.lit(0))


def _high_before(leap: Column, month: int) -> Column:
    return F.lit(HIGH_BEFORE[month]) + F.when(leap, 1 if month > 1 else 0).otherwise(0)


def _other_day(y: Column, m: Column, d: Column, key: str) -> Column:
    """(y, m, d) of the day that the permutation gives for a valid day."""

    def low() -> Column:
        x = feistel_number((y - YEARS[0]).cast("long") * 144 + (m - 1) * 12 + d - 1, LOW_A, LOW_B, "date low", key)
        return let(x, lambda v: F.struct((F.floor(v / 144) + YEARS[0]).alias("y"), (F.floor(v / 12) % 12 + 1).alias("m"), (v % 12 + 1).alias("d")))

    def high() -> Column:
        before = F.array(*[_high_before(_is_leap(y), k) for k in range(12)])
        turn = lambda v: feistel_number(v, HIGH_A, HIGH_B, "date high", key)
        # at most HIGH_A * HIGH_B - HIGH numbers in a row are none of a day
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(HIGH_A * HIGH_B - HIGH)), turn((y - YEARS[0]).cast("long") * 221 + _leaps(y) + F.get(before, m - 1) + d - 13), lambda v, _: F.when(v < HIGH, v).otherwise(turn(v)))

        def in_year(v: Column, year: Column) -> Column:
            rest, starts = v - _first(year), F.array(*[_high_before(_is_leap(year), k) for k in range(12)])
            month = F.size(F.filter(starts, lambda s: s <= rest))
            return F.struct(year.cast("long").alias("y"), month.cast("long").alias("m"), (rest - F.get(starts, month - 1) + 13).cast("long").alias("d"))

        def of(v: Column) -> Column:
            guess = F.floor(v / 221) + YEARS[0]
            return let(F.struct(v.alias("v"), F.when(_first(guess) <= v, guess).otherwise(guess - 1).alias("y")), lambda s: in_year(s["v"], s["y"]))

        return let(walk, of)

    return F.when(d <= 12, low()).otherwise(high())


def _is_leap(year: Column) -> Column:
    """Inside the years of valid dates."""
    return (year % 4 == 0) & (year != 1900)


def _first(year: Column) -> Column:
    """Later days before this year."""
    return (year - YEARS[0]) * 221 + _leaps(year)


def _date(m: Column, key: str) -> Column:
    """ISO, dd.mm.yyyy and dd/mm/yyyy (mm/dd/yyyy where the second number is above 12); the patterns hold the calendar."""
    n = lambda at, size=2: m.substr(F.lit(at), F.lit(size)).cast("int")
    iso, us = m.like("____-__-__"), m.like("__/__/____") & (n(4) > 12)

    def new(v: Column) -> Column:
        text = lambda c: F.lpad(c.cast("string"), 2, "0")
        y, mo, d = v["y"].cast("string"), text(v["m"]), text(v["d"])
        return F.when(iso, F.concat_ws("-", y, mo, d)).when(us, F.concat_ws("/", mo, d, y)).when(m.like("__/__/____"), F.concat_ws("/", d, mo, y)).otherwise(F.concat_ws(".", d, mo, y))

    given = F.when(iso, F.struct(n(1, 4).alias("y"), n(6).alias("m"), n(9).alias("d"))).when(us, F.struct(n(7, 4).alias("y"), n(1).alias("m"), n(4).alias("d"))).otherwise(F.struct(n(7, 4).alias("y"), n(4).alias("m"), n(1).alias("d")))
    return let(given, lambda g: let(_other_day(g["y"], g["m"], g["d"], key), new))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    x = (area - F.when(area > 666, 2).otherwise(1)) * SSN_B + (group - 1) * 9999 + serial - 1
    text = lambda c, n: F.lpad(c.cast("string"), n, "0")

    def shown(y: Column) -> Column:
        a, rest = F.floor(y / SSN_B), y % SSN_B
        return F.concat_ws("-", text(a + F.when(a > 664, 2).otherwise(1), 3), text(F.floor(rest / 9999) + 1, 2), text(rest % 9999 + 1, 4))

    return F.when(valid, let(feistel_number(x.cast("long"), SSN_A, SSN_B, "ssn", key), shown))


def valid_card(digits: Column) -> Column:
    return (luhn_sum(digits, 1) % 10 == 0) & digits.rlike("[1-9]")


def _card(m: Column, key: str) -> Column:
    """The first digit (the kind of issuer) stays, the check digit is computed anew."""
    d = _digits(m)
    body = d.substr(F.lit(2), F.length(d) - 2)
    new = F.concat(d.substr(F.lit(1), F.lit(1)), feistel_text(body, _classes(body), "card", key))
    check = lambda v: ((10 - luhn_sum(v, 0) % 10) % 10).cast("string")
    return F.when(valid_card(d), let(new, lambda v: _refill(m, F.concat(v, check(v)), "[0-9]")))


def _phone(m: Column, key: str) -> Column:
    """North American numbers: area and exchange keep a first digit from 2 to 9."""
    country = F.regexp_extract(m, r"^((?:\+|00)1[ .\-]?)?", 0)
    local = m.substr(F.length(country) + 1, F.length(m))
    return F.concat(country, _refill(local, feistel_text(_digits(local), F.lit("nddndddddd"), "phone", key), "[0-9]"))


def _intl_phone(m: Column, key: str) -> Column:
    """The first two digits stay with the country, from 8 to 15 digits in all, without a leading 00."""
    dial = F.when(m.startswith("00"), F.lit("00")).otherwise(F.lit(""))
    d = _digits(m).substr(F.length(dial) + 1, F.length(m))
    body = d.substr(F.lit(3), F.length(d))
    new = F.concat(dial, d.substr(F.lit(1), F.lit(2)), feistel_text(body, _classes(body), "intl_phone", key))
    return F.when((F.length(d) >= 8) & (F.length(d) <= 15), _refill(m, new, "[0-9]"))


def _ipv4(m: Column, key: str) -> Column:
    """Unicast addresses outside 10.0.0.0/8 and 127.0.0.0/8, without leading zeros."""
    o = [F.split(m, r"\.")[i].cast("int") for i in range(4)]
    valid = (o[0] >= 1) & (o[0] <= 223) & ~o[0].isin(10, 127) & (F.greatest(*o) <= 255) & (F.concat_ws(".", *o) == m)
    first = o[0] - 1 - F.when(o[0] > 127, 2).when(o[0] > 10, 1).otherwise(0)
    y = feistel_number(((first * 256 + o[1]).cast("long") * 256 + o[2]) * 256 + o[3], IP_A, IP_B, "ipv4", key)

    def shown(y: Column) -> Column:
        a = F.floor(y / (1 << 24)) + 1
        return F.concat_ws(".", a + F.when(a >= 126, 2).when(a >= 10, 1).otherwise(0), F.floor(y / 65536) % 256, F.floor(y / 256) % 256, y % 256)

    return F.when(valid, let(y, shown))


REPLACE = {"email": _email, "secret": _secret, "access_id": _access_id, "iban": _iban, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone, "intl_phone": _intl_phone, "ipv4": _ipv4}


def pseudonym(candidate: Column, key: str) -> Column:
    """(kind, new) of one candidate; new is null where it fails its kind's validation."""
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("new"))
    out = none
    for kind in reversed(KINDS):
        pattern = KINDS[kind]
        out = F.when(candidate.rlike(rf"\A(?:{pattern})\z"), F.struct(F.lit(kind).alias("kind"), REPLACE[kind](candidate, key).alias("new"))).otherwise(out)
    return out


def _valid_values(t: Column) -> tuple[Column, Column]:
    """The distinct valid IBANs and cards of a text, at every position and length that ends with a group; longest first."""

    def of(kind: str, parts: Callable[[Column], Column], check: Callable[[Column, str], Column]) -> Column:
        spans = F.array_distinct(F.regexp_extract_all(t, F.lit(LONGEST[kind]), F.lit(1)))
        valid = F.filter(F.flatten(F.transform(spans, parts)), lambda m: m.rlike(rf"\A(?:{KINDS[kind]})\z") & F.coalesce(check(m), F.lit(False)))
        by_length = F.array_sort(F.transform(F.array_distinct(valid), lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m"))))
        return F.transform(by_length, lambda x: x["m"])

    def groups(m: Column) -> Column:
        return let(F.split(m, " "), lambda g: F.transform(F.sequence(F.lit(1), F.size(g)), lambda j: F.array_join(F.slice(g, F.lit(1), j), " ")))

    def lengths(m: Column) -> Column:
        return F.array(*[F.regexp_extract(m, rf"\A[0-9](?:[ \-]?[0-9]){{{n - 1}}}(?![0-9])", 0) for n in range(13, 20)])

    return of("iban", groups, lambda m: valid_iban(F.regexp_replace(m, " ", ""))), of("card", lengths, lambda m: valid_card(_digits(m)))


def _scanned(t: Column, key: str) -> Column:
    """(text, found): a text with its values replaced, and (kind, new) of each.

    Every value is valid before the scan, which therefore never skips a span that it then keeps.
    """
    ibans, cards = _valid_values(t)

    def literal(values: Column, before: str, after: str) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f"|(?<!{before})(?:"), F.array_join(values, "|"), F.lit(f")(?!{after})"))).otherwise(F.lit(""))

    first = "|".join(SEARCH[k] for k in ("email", "secret", "access_id"))
    rest = "|".join(SEARCH[k] for k in ("date", "ssn", "phone", "intl_phone"))

    def scan(v: Column) -> Column:
        none = (F.size(v["ibans"]) == 0) & (F.size(v["cards"]) == 0)
        pattern = F.concat(F.lit(first), literal(v["ibans"], "[A-Za-z0-9]", "[A-Za-z0-9]"), F.lit("|" + rest), literal(v["cards"], "[0-9]", "[0-9]"), F.lit("|" + SEARCH["ipv4"]))
        found = F.when(none, F.regexp_extract_all(v["t"], F.lit(f"({CANDIDATE})"), F.lit(1))).otherwise(F.regexp_extract_all(v["t"], F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1)))
        between = F.when(none, F.split(v["t"], CANDIDATE, -1)).otherwise(F.split(v["t"], pattern, -1))
        new = F.transform(found, lambda m: let(pseudonym(m, key), lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("new"), F.coalesce(x["new"], m).alias("shown"))))
        return let(new, lambda n: F.struct(
            F.concat_ws("", F.zip_with(between, n, lambda p, m: F.concat(p, F.coalesce(m["shown"], F.lit(""))))).alias("text"),
            F.transform(F.filter(n, lambda f: f["new"].isNotNull()), lambda f: F.struct(f["kind"].alias("kind"), f["new"].alias("new"))).alias("found"),
        ))

    return let(F.struct(t.alias("t"), ibans.alias("ibans"), cards.alias("cards")), scan)


def pseudonymised(docs: DataFrame, key: str, text: str = "text", findings: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``findings`` names a column for (kind, new) of each one."""
    t = F.col(text)
    none = F.struct(t.alias("text"), F.array().cast("array<struct<kind:string,new:string>>").alias("found"))
    scanned = F.when(t.rlike(HINT), _scanned(t, key)).otherwise(none)
    if not findings:
        return docs.withColumn(text, scanned["text"])
    # one struct for both columns, so that a text is scanned once
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, findings)]
    out = docs.select(*rest, *[F.col(f"`{c}`") for c in docs.columns if c == text], F.array(scanned).alias("__scanned"))
    x = F.col("__scanned")[0]
    names = [c for c in docs.columns if c != findings] + [findings]
    return out.select(*[x["text"].alias(text) if c == text else x["found"].alias(findings) if c == findings else F.col(f"`{c}`") for c in names])
