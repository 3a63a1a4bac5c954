"""Format-preserving pseudonyms for personal numbers and dates.

Validated card numbers, telephone numbers, addresses of machines, social security numbers, dates and the names in mail
addresses are found, and each is replaced by another value of the same format: a keyed Feistel network permutes
the values of a format, so equal values get equal pseudonyms in all documents and different ones stay different.
Card numbers keep their issuer digit and get a fitting check digit; dates stay real days; addresses stay addresses.

All work is in DataFrame functions. A text is split at its matches inside the row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import unused

ROUNDS = 8
#: Days that dates are permuted among, both included.
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
#: Kinds and their formats. A match never touches further digits or letters.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "ip": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)",
    "date": r"(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])",
    "ssn": r"(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}",
    "phone": r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}",
    "card": r"\d(?:[ \-]?\d){12,18}",
}
ANY = r"(?<![A-Za-z0-9@.+])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + r")(?![A-Za-z0-9@]|\.\d)"


def _div(a: Column, b: Column | int) -> Column:
    """Whole quotient of two longs."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def _round(secret: str, kind: str, number: Column | int, half: Column) -> Column:
    """A keyed number of 60 bits for one half."""
    number = F.lit(number) if isinstance(number, int) else number
    digest = F.sha2(F.concat_ws("|", F.lit(secret), F.lit(kind), number.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permuted(value: Column, size: Column, secret: str, kind: str) -> Column:
    """A keyed permutation of 0 .. size - 1 for sizes below 10^18.

    The value is cut at a base near the square root of the size, and the halves take turns in adding a keyed
    number of the other. Results beyond the size are permuted again until they fall inside (cycle walking), as
    often as needed within 64 walks, each of which stays outside with a chance of less than one half.
    """
    base = F.greatest(F.ceil(F.sqrt(size.cast("double"))), F.lit(2)).cast("long")

    def once(x: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(_round(secret, kind, i, s["b"]), base), base).alias("b"))

        start = F.struct(_div(x, base).alias("a"), F.pmod(x, base).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["a"] * base + s["b"])

    def walk(s: Column, i: Column) -> Column:
        return F.when((i > 1) & (s < size), s).otherwise(once(s))

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), value, walk)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it occurs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order."""
    def fill(new: Column) -> Column:
        one = lambda i: F.substring(form, i, F.lit(1))
        nth = lambda i: F.length(_digits(F.substring(form, F.lit(1), i)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(
            one(i).rlike(r"\d"), F.substring(new, nth(i), F.lit(1))).otherwise(one(i))), "")

    return _let(digits, fill)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _as_number(digits: Column, secret: str, kind: str) -> Column:
    """Another string of as many digits (at most 17)."""
    return F.lpad(permuted(digits.cast("long"), _power(F.length(digits)), secret, kind).cast("string"), F.length(digits), F.lit("0"))


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled (the last is not)."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, x: a + x)


def _card(s: Column, secret: str) -> Column:
    digits = _digits(s)
    body = F.concat(F.substring(digits, 1, 1), _as_number(F.substring(digits, F.lit(2), F.length(digits) - 2), secret, "card"))
    check = lambda b: F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return _refilled(s, _let(body, lambda b: F.concat(b, check(b))))


def _phone(s: Column, secret: str) -> Column:
    """The last ten digits change, the country code stays; a first digit of 0 stays 0 and others never become 0."""
    digits = _digits(s)
    tail = F.right(digits, F.lit(10))
    low = F.when(F.substring(tail, 1, 1) == "0", F.lit(0)).otherwise(F.lit(10 ** 9)).cast("long")
    size = F.when(low == 0, F.lit(10 ** 9)).otherwise(F.lit(9 * 10 ** 9)).cast("long")
    new = F.lpad((permuted(tail.cast("long") - low, size, secret, "phone") + low).cast("string"), 10, "0")
    return _refilled(s, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), new))


def _ip(s: Column, secret: str) -> Column:
    part = lambda i: F.element_at(F.split(s, r"\."), i).cast("long")
    value = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    return _let(permuted(value, F.lit(1 << 32).cast("long"), secret, "ip"), lambda new: F.concat_ws(
        ".", *[F.pmod(F.shiftright(new, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)]))


def _ssn(s: Column, secret: str) -> Column:
    """Area (898 possible), group (99) and serial (9999) as one number, so that the pseudonym is valid, too."""
    digits = _digits(s)
    area = F.substring(digits, 1, 3).cast("long")
    rank = area - F.when(area > 666, 2).otherwise(1)
    value = (rank * 99 + F.substring(digits, 4, 2).cast("long") - 1) * 9999 + F.substring(digits, 6, 4).cast("long") - 1
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def written(new: Column) -> Column:
        area = _div(new, 99 * 9999)
        return F.concat_ws("-", pad(area + F.when(area >= 665, 2).otherwise(1), 3), pad(F.pmod(_div(new, 9999), F.lit(99)) + 1, 2),
                           pad(F.pmod(new, F.lit(9999)) + 1, 4))

    return _let(permuted(value, F.lit(898 * 99 * 9999).cast("long"), secret, "ssn"), written)


def _date(s: Column, secret: str) -> Column:
    first, last = F.to_date(F.lit(FIRST_DAY)), F.to_date(F.lit(LAST_DAY))
    size = (F.datediff(last, first) + 1).cast("long")
    day = permuted(F.datediff(F.try_to_date(s, "yyyy-MM-dd"), first).cast("long"), size, secret, "date")
    return F.date_format(F.date_add(first, day.cast("int")), "yyyy-MM-dd")


def _email(s: Column, secret: str) -> Column:
    """Each letter and digit before the @ moves within its own kind.

    The name is permuted as pairs of halves: every character of one half is shifted by keyed numbers of the other
    half, in turns, which is a Feistel network over the alphabets the characters belong to.
    """
    name, site = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    small, large, figures = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def shifted(half: Column, other: Column, number: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substring(half, i, F.lit(1))
            by = _round(secret, "email", number * 1000 + i, other)
            move = lambda letters: F.substring(F.lit(letters), (F.pmod(F.position(c, F.lit(letters)) - 1 + F.pmod(by, F.lit(len(letters))), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
            return F.when(c.rlike("[a-z]"), move(small)).when(c.rlike("[A-Z]"), move(large)).when(c.rlike("[0-9]"), move(figures)).otherwise(c)

        return F.when(F.length(half) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), "")).otherwise(F.lit(""))

    cut = F.floor((F.length(name) + 1) / 2).cast("int")
    start = F.struct(F.substring(name, F.lit(1), cut).alias("a"), F.substring(name, cut + 1, F.length(name)).alias("b"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, lambda st, i: _let(shifted(st["a"], st["b"], 2 * i), lambda a: F.struct(
        a.alias("a"), shifted(st["b"], a, 2 * i + 1).alias("b"))), lambda st: F.concat(st["a"], st["b"]))
    return F.concat(done, F.lit("@"), site)


MAKERS: dict[str, Callable[[Column, str], Column]] = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(s: Column) -> Column:
    """Kind of a match, null where it is not valid: card numbers need their check digit, dates a real day."""
    whole = lambda kind: s.rlike("^(?:" + PATTERNS[kind] + ")$")
    digits = _digits(s)
    return (F.when(whole("email"), F.lit("email")).when(whole("ip"), F.lit("ip"))
            .when(whole("date"), F.when(F.try_to_date(s, "yyyy-MM-dd").isNotNull(), F.lit("date")))
            .when(whole("ssn"), F.lit("ssn")).when(whole("phone"), F.lit("phone"))
            .when(whole("card") & (F.pmod(luhn_sum(digits), F.lit(10)) == 0), F.lit("card")))


def pseudonymise(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """``docs`` with the personal values of ``text`` replaced, and ``n_<kind>`` with how many of each kind were.

    Equal values written alike get equal pseudonyms for one ``secret`` in all documents; the separators of a number are
    kept. Numbers that look like a kind but are not valid stay. Null texts stay null with counts of 0; empty texts
    and texts without digits or @ pass unchanged. Columns named like the counts are replaced, others are kept.
    """
    names = {kind: f"n_{kind}" for kind in MAKERS}
    docs = docs.drop(*names.values())
    columns = docs.columns
    parts_name, found_name, new_name = (unused(docs, name) for name in ("_parts", "_found", "_new"))
    worth = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("was"), kind_of(m).alias("kind")))
    split = docs.withColumns({parts_name: F.when(worth, F.split(text, ANY, -1)), found_name: F.when(worth, found)})

    def new(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, make in MAKERS.items():
            out = F.when(m["kind"] == kind, make(m["was"], secret)).otherwise(out)
        return F.coalesce(out, m["was"])

    made = split.withColumn(new_name, F.when(F.size(found_name) > 0, F.transform(found_name, new)))
    joined = F.array_join(F.transform(parts_name, lambda x, i: F.concat(x, F.coalesce(F.get(new_name, i), F.lit("")))), "")
    kinds = F.transform(found_name, lambda m: m["kind"])
    counts = {name: F.coalesce(F.size(F.filter(kinds, lambda x: x == kind)), F.lit(0)).cast("long") for kind, name in names.items()}  # noqa: B023
    return made.withColumns({text: F.when(F.size(found_name) > 0, joined).otherwise(F.col(text))} | {
        name: F.greatest(c, F.lit(0)) for name, c in counts.items()}).select(*columns, *names.values())
