"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame functions only.

Each value is permuted within its format by a keyed Feistel network: two halves, each in turn moved by a keyed hash of the other. The
permutation depends on the key, the kind of value and its size alone, so equal values stay equal in all documents, whatever
separators they are written with, and different values of a kind stay different.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: First day and number of days of the dates that are permuted: the years 1900 to 2099. The number is 17 times 4297.
_FIRST_DAY = "1900-01-01"
_DAY_HALVES = (17, 4297)
#: Fixed value: letters besides a-z that an address may hold and that are permuted among themselves.
_ACCENTED = "àáâäåæçèéêëíîïñóôöøùúûüýßœ"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What is looked for, in the order tried at each place.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\w|[/.-]\d)",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ -]?\d{2,4}){2,4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}(?:\.\d{2,4}){2,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "social": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)",
}
_ANY = "|".join(f"(?:{p})" for p in KINDS.values())
_LEAST_DIGITS, _MOST_DIGITS = 7, 19


def _number(key: str, tweak: Column, i: Column, half: Column) -> Column:
    """A keyed hash of one half as a number below 2^60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs (left, right) below (left_size, right_size), as a struct `l`, `r`."""

    def step(a: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        moved_l = F.pmod(a["l"] + F.pmod(_number(key, tweak, i, a["r"]), left_size), left_size)
        moved_r = F.pmod(a["r"] + F.pmod(_number(key, tweak, i, a["l"]), right_size), right_size)
        return F.struct(F.when(even, moved_l).otherwise(a["l"]).alias("l"), F.when(even, a["r"]).otherwise(moved_r).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(1, 11)]), n)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of two to twenty digits permuted among those of its length."""
    n = F.length(digits)
    u = (n / 2).cast("int")
    v = n - u
    out = feistel(F.substr(digits, F.lit(1), u), F.substr(digits, u + 1), _power(u), _power(v), key, F.concat_ws(":", F.lit(kind), n.cast("string")))
    # each half is used once, so that the network is evaluated once
    return F.element_at(F.transform(F.array(out), lambda p: F.concat(F.lpad(p["l"].cast("string"), u, F.lit("0")), F.lpad(p["r"].cast("string"), v, F.lit("0")))), 1)


def _refilled(value: Column, digits: Column) -> Column:
    """`value` with its digits replaced in order by `digits`."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("s"))

    def step(a: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.when(digit, a["k"] + 1).otherwise(a["k"]).alias("k"), F.concat(a["s"], F.when(digit, F.substr(digits, a["k"] + 1, F.lit(1))).otherwise(c)).alias("s"))

    return F.aggregate(F.split(value, ""), start, step, lambda a: a["s"])


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """`use(value)` with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _plain_number(value: Column, key: str, kind: str) -> Column:
    return _let(F.regexp_replace(value, "[^0-9]", ""), lambda d: _let(permuted_digits(d, key, kind), lambda new: _refilled(value, new)))


def _check_digit(body: Column) -> Column:
    """The digit that makes `body` and it pass the Luhn check."""
    return F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(body, c.cast("string")))), 1)


def _card(value: Column, key: str) -> Column:
    """The digits before the last are permuted; the last keeps its distance from the right check digit, so right numbers stay right and wrong ones wrong."""

    def new(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        off = F.right(d, F.lit(1)).cast("int") - _check_digit(body)
        return _let(permuted_digits(body, key, "card"), lambda b: F.concat(b, F.pmod(_check_digit(b) + off, F.lit(10)).cast("string")))

    return _let(F.regexp_replace(value, "[^0-9]", ""), lambda d: _let(new(d), lambda n: _refilled(value, n)))


def _ip(value: Column, key: str) -> Column:
    parts = lambda o: feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("ip"))
    dotted = lambda p: F.concat_ws(".", *[F.shiftright(p[h], s).bitwiseAND(F.lit(255).cast("long")).cast("string") for h in ("l", "r") for s in (8, 0)])
    return _let(F.transform(F.split(value, r"\."), lambda x: x.cast("long")), lambda o: _let(parts(o), dotted))


def _date(value: Column, key: str) -> Column:
    """A real date of the years 1900 to 2099, in the notation it came in; anything else stays."""
    a, b = (F.lit(x).cast("long") for x in _DAY_HALVES)
    first = F.lit(_FIRST_DAY).cast("date")

    def written(day: Column) -> Column:
        p = feistel((day / b).cast("long"), F.pmod(day, b), a, b, key, F.lit("date"))
        new = lambda q: F.date_add(first, (q["l"] * b + q["r"]).cast("int"))
        shown = lambda d: F.when(value.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(value.contains("/"), F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))
        return F.when(day.between(0, _DAY_HALVES[0] * _DAY_HALVES[1] - 1), _let(_let(p, new), shown)).otherwise(value)

    iso = F.when(value.contains("-"), value).otherwise(F.concat_ws("-", F.substr(value, F.lit(7), F.lit(4)), F.substr(value, F.lit(4), F.lit(2)), F.substr(value, F.lit(1), F.lit(2))))
    return F.coalesce(_let(F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), first).cast("long"), lambda day: F.when(day.isNotNull(), written(day))), value)


def _email(value: Column, key: str) -> Column:
    """The part before the @: letters among letters and digits among digits, in the case they came in. The domain stays."""
    local = F.element_at(F.split(value, "@"), 1)
    low = F.lower(local)
    u = (F.length(low) / 2).cast("int")

    def moved(s: Column, mask: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            k = F.conv(F.substr(mask, F.pmod(i, F.lit(30)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            turned = lambda first, size: F.chr(F.lit(first).cast("long") + F.pmod(F.ascii(c) - first + k, F.lit(size)).cast("long"))
            other = F.instr(F.lit(_ACCENTED), c)
            return (
                F.when(c.between("a", "z"), turned(97, 26))
                .when(c.between("0", "9"), turned(48, 10))
                .when((F.length(c) == 1) & (other > 0), F.substr(F.lit(_ACCENTED), F.pmod(other - 1 + k, F.lit(len(_ACCENTED))) + 1, F.lit(1)))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(s, ""), one), "")

    def step(a: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        mask = lambda half: F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), F.length(low).cast("string"), half), 256)
        return F.struct(F.when(even, moved(a["l"], mask(a["r"]))).otherwise(a["l"]).alias("l"), F.when(even, a["r"]).otherwise(moved(a["r"], mask(a["l"]))).alias("r"))

    start = F.struct(F.substr(low, F.lit(1), u).alias("l"), F.substr(low, u + 1).alias("r"))
    new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda a: F.concat(a["l"], a["r"]))
    cased = lambda n: F.array_join(F.zip_with(F.split(local, ""), F.split(n, ""), lambda o, c: F.when(o != F.lower(o), F.upper(c)).otherwise(c)), "")
    return F.concat(_let(new, cased), F.substr(value, F.length(local) + 1))


def kind_of(value: Column) -> Column:
    """Which of `KINDS` a found value is."""
    first, *rest = KINDS
    whole = {k: value.rlike(f"^(?:{p})$") for k, p in KINDS.items()}
    return reduce(lambda c, k: c.when(whole[k], k), rest, F.when(whole[first], first)).otherwise("card")


def pseudonym(value: Column, key: str) -> Column:
    kind = kind_of(value)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))

    def new(k: Column) -> Column:
        return (
            F.when(k == "email", _email(value, key))
            .when(k == "date", _date(value, key))
            .when(k == "ip", _ip(value, key))
            .when(~digits.between(_LEAST_DIGITS, _MOST_DIGITS), value)
            .when(k == "phone", _plain_number(value, key, "phone"))
            .when(k == "social", _plain_number(value, key, "social"))
            .otherwise(_card(value, key))
        )

    return _let(kind, new)


def pseudonymized(docs: DataFrame, key: str, found: str = "n_found") -> DataFrame:
    """`docs` with the personal values in `text` replaced by pseudonyms of the same format, and the count of values in column `found`.

    E-mail addresses (their local part), dates of the years 1900 to 2099, IPv4 addresses, phone numbers, social security numbers and numbers of 13
    to 19 digits are looked for (`KINDS`); dates must exist, octets must be in range, and numbers with a right Luhn digit
    keep one, others none. Everything else in a text stays. Null stays null with a count of 0, as do empty texts; rows and other columns stay as they are;
    `found` must not be one of them. No shuffle.
    """
    if found in docs.columns:
        raise ValueError(f"docs has a column {found} already")
    names = docs.columns
    # gaps and values stand in columns of their own, so that each expression runs once on a text
    hits, gaps = "_pseudonym_hits", "_pseudonym_gaps"
    rows = docs.withColumn(hits, F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)))
    rows = rows.withColumn(gaps, F.when(F.size(hits) > 0, F.split("text", _ANY)))
    glued = F.array_join(F.zip_with(gaps, F.concat(F.transform(hits, lambda v: pseudonym(v, key)), F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")
    text = F.when(F.size(hits) > 0, glued).otherwise(F.col("text")).alias("text")
    return rows.select(*[text if c == "text" else F.col(f"`{c}`") for c in names], F.greatest(F.lit(0), F.coalesce(F.size(hits), F.lit(0))).cast("long").alias(found))
