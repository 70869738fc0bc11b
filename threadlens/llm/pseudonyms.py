"""Format-preserving pseudonyms for numbers and dates, in DataFrame functions only.

Payment cards (Luhn), phone numbers, US social security numbers, IPv4 addresses
and dates are found in the text, validated, and mapped by a keyed Feistel
network to another valid value of the same format and layout.

Dates: year-month-day; day.month.year; day/month/year, and month/day/year where
the second part is above 12 (where both can be months the day comes first, so
an American date of the first twelve days is read as a European one); and
English written months, whole or of three letters. Days and months may have one
digit, except after a year. Phones: North American ones; with (area) or +1 also
those whose area code begins with 0 or 1; and + with a country code other than
1, 8 to 15 digits in all, whose first two stay. Not covered: years outside 1900
to 2099, two-digit years, months in capitals or other languages, international
phones without +, local phones without an area code, IPv6.

 The network works on pairs (l, r) of Z_a x Z_b with a x b exactly the
number of values of the format, and adds a keyed hash of one half to the other
modulo its size, so it is a permutation: equal values stay equal in all
documents, different ones stay different, and nobody without the key can tell
which is which. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import text_or_empty

ROUNDS = 10
_EDGE = r"(?<![0-9A-Za-z])(?<![0-9][.])"
_END = r"(?![0-9A-Za-z])"
_YEAR, _MONTH, _DAY = "(?:19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
_DAY1, _MONTH1 = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])"
_NAME = ("(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|"
         "Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)")
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Shapes; what has one is validated further by ``_pseudonym``. Of two shapes at one place the first counts.
SHAPES = {
    "date": (f"{_YEAR}-{_MONTH}-{_DAY}|{_DAY1}[.]{_MONTH1}[.]{_YEAR}|{_DAY1}/{_MONTH1}/{_YEAR}|{_MONTH1}/{_DAY1}/{_YEAR}"
             f"|{_DAY1} {_NAME} {_YEAR}|{_NAME} {_DAY1},? {_YEAR}"),
    "ipv4": f"{_OCTET}(?:[.]{_OCTET}){{3}}(?![.][0-9])",
    "phone": ("(?:[+]?1[ .-]?)?(?:[(][0-9]{3}[)] ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}"
              "|[+]1[ .-]?[01][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}"
              "|[+][2-9][0-9]{0,2}(?:[ .-]?(?:[(][0-9]{1,4}[)]|[0-9]{1,4})){2,5}"),
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": "[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
}
KINDS = tuple(SHAPES)
PATTERN = _EDGE + "(?:" + "|".join(SHAPES.values()) + ")" + _END
#: Days from 1900-01-01 to 2099-12-31: 17 x 4297.
_DATES = (17, 4297)


def feistel(key: str, label: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """(l, r) after the keyed rounds: a permutation of Z_a x Z_b for each label."""

    def round_value(i: Column, x: Column) -> Column:
        mixed = F.sha2(F.concat_ws(":", F.lit(key), label, i.cast("string"), x.cast("string")), 256)
        return F.conv(F.substring(mixed, 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, (s["l"] + round_value(i, s["r"]) % a) % a).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise((s["r"] + round_value(i, s["l"]) % b) % b).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits (the last one counts once)."""
    back = F.reverse(digits)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + F.when(
        i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(
        (F.substring(back, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(back, i, F.lit(1)).cast("int") / 5).cast("int")))


def _in_layout(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        is_digit = (c >= "0") & (c <= "9")
        return F.struct((s["i"] + F.when(is_digit, 1).otherwise(0)).alias("i"),
                        F.concat(s["out"], F.when(is_digit, F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.regexp_extract_all(layout, F.lit("(?s)."), F.lit(0)), start, step, lambda s: s["out"])


def _padded(value: Column, width) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _number(text: Column, start, length) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(text, as_col(start), as_col(length)).cast("long")


def _card(hit: Column, key: str) -> tuple[Column, Column]:
    digits = F.regexp_replace(hit, "[ -]", "")
    n = F.length(digits) - 2  # the first digit (network) stays, the last one is the check digit
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    moved = feistel(key, F.concat(F.lit("card"), F.substring(digits, 1, 1), F.length(digits).cast("string")),
                    _number(digits, 2, u), _number(digits, u + 2, n - u), ten(u), ten(n - u))
    # an array of one and transform bind the value once instead of repeating its expression
    body = F.transform(F.array(moved), lambda m: F.concat(
        F.substring(digits, 1, 1), _padded(m["l"], u), _padded(m["r"], n - u)))
    whole = F.transform(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return luhn_sum(digits) % 10 == 0, F.transform(whole, lambda w: _in_layout(hit, w))[0]


def _phone(hit: Column, key: str) -> tuple[Column, Column]:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    abroad = hit.rlike("^[+][2-9]")
    code = F.when(F.length(digits) == 11, "1").otherwise("")
    d = F.substring(digits, -10, 10)
    # area codes from 200 on, and those below, are formats of their own
    low = F.substring(d, 1, 1) < "2"
    first, areas = F.when(low, 0).otherwise(200), F.when(low, 200).otherwise(800)
    moved = feistel(key, F.when(low, "phone0").otherwise("phone"), _number(d, 1, 3) - first,
                    (_number(d, 4, 3) - 200) * 10_000 + _number(d, 7, 4), areas, F.lit(8_000_000))
    new = F.transform(F.array(moved), lambda m: _in_layout(hit, F.concat(
        code, _padded(m["l"] + first, 3), (F.floor(m["r"] / 10_000) + 200).cast("string"),
        _padded(m["r"] % 10_000, 4))))
    n = F.length(digits) - 2
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    other = feistel(key, F.concat(F.lit("phone+"), F.substring(digits, 1, 2), F.length(digits).cast("string")),
                    _number(digits, 3, u), _number(digits, u + 3, n - u), ten(u), ten(n - u))
    world = F.transform(F.array(other), lambda m: _in_layout(hit, F.concat(
        F.substring(digits, 1, 2), _padded(m["l"], u), _padded(m["r"], n - u))))
    return ~abroad | F.length(digits).between(8, 15), F.when(abroad, world[0]).otherwise(new[0])


def _ssn(hit: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = _number(hit, 1, 3), _number(hit, 5, 2), _number(hit, 8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    moved = feistel(key, F.lit("ssn"), area - 1 - F.when(area > 666, 1).otherwise(0),
                    (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    new = F.transform(F.array(moved), lambda m: F.concat_ws(
        "-", _padded(m["l"] + 1 + F.when(m["l"] >= 665, 1).otherwise(0), 3),
        _padded(F.floor(m["r"] / 9999) + 1, 2), _padded(m["r"] % 9999 + 1, 4)))
    return valid, new[0]


def _ipv4(hit: Column, key: str) -> tuple[Column, Column]:
    part = F.transform(F.split(hit, "[.]"), lambda x: x.cast("long"))
    moved = feistel(key, F.lit("ipv4"), part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65_536), F.lit(65_536))
    new = F.transform(F.array(moved), lambda m: F.concat_ws(
        ".", F.floor(m["l"] / 256), m["l"] % 256, F.floor(m["r"] / 256), m["r"] % 256))
    return F.lit(True), new[0]


def _date(hit: Column, key: str) -> tuple[Column, Column]:
    iso, name = hit.rlike("^[0-9]{4}-"), F.regexp_extract(hit, "[A-Z][a-z]+", 0)
    part = lambda i: F.get(F.split(hit, "[-./]"), F.lit(i))
    month_first = hit.contains("/") & (part(1).try_cast("int") > 12)
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.substring(name, 1, 3)).cast("string")
    two = lambda c: F.lpad(c, 2, "0")
    text = (F.when(iso, hit)
            .when(name != "", F.concat_ws("-", F.regexp_extract(hit, "[0-9]{4}", 0), two(month),
                                          two(F.regexp_extract(hit, "(?<![0-9])[0-9]{1,2}(?![0-9])", 0))))
            .when(month_first, F.concat_ws("-", part(2), two(part(0)), two(part(1))))
            .otherwise(F.concat_ws("-", part(2), two(part(1)), two(part(0)))))
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    zero = F.lit("1900-01-01").cast("date")
    n = F.datediff(day, zero)
    moved = feistel(key, F.lit("date"), F.floor(n / _DATES[1]), n % _DATES[1], F.lit(_DATES[0]), F.lit(_DATES[1]))
    new = F.transform(F.array(moved), lambda m: F.date_add(zero, (m["l"] * _DATES[1] + m["r"]).cast("int")))
    short = hit.rlike("^[0-9][^0-9]|[/. ][0-9](?![0-9])")  # a part of one digit: no part is padded

    def shown(d: Column) -> Column:
        year = F.year(d).cast("string")
        width = F.when(short, 1).otherwise(2)
        number = lambda c: F.lpad(c.cast("string"), F.greatest(width, F.length(c.cast("string"))), "0")
        dd, mm = number(F.dayofmonth(d)), number(F.month(d))
        word = F.when(F.length(name) == 3, F.date_format(d, "MMM")).otherwise(F.date_format(d, "MMMM"))
        mark = F.regexp_extract(hit, "[./]", 0)
        return (F.when(iso, F.date_format(d, "yyyy-MM-dd"))
                .when(hit.rlike("^[A-Z]"), F.concat(word, F.lit(" "), dd, F.when(hit.contains(","), ", ").otherwise(" "), year))
                .when(name != "", F.concat_ws(" ", dd, word, year))
                .when(month_first, F.concat(mm, mark, dd, mark, year))
                .otherwise(F.concat(dd, mark, mm, mark, year)))

    return day.isNotNull(), F.transform(new, shown)[0]


_KINDS = {"date": _date, "ipv4": _ipv4, "phone": _phone, "ssn": _ssn, "card": _card}


def _pseudonym(hit: Column, key: str) -> Column:
    """struct(kind, hit, new); kind is null and new the hit itself if it does not validate."""
    kind, new = F.lit(None).cast("string"), hit
    for name in reversed(KINDS):
        valid, moved = _KINDS[name](hit, key)
        shaped = hit.rlike(f"^(?:{SHAPES[name]})$")
        kind = F.when(shaped, F.when(valid, name)).otherwise(kind)
        new = F.when(shaped, F.when(valid, moved).otherwise(hit)).otherwise(new)
    return F.struct(kind.alias("kind"), hit.alias("hit"), new.alias("new"))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text with pseudonyms in place of the
    values, and ``pii``: array of (kind, hit, new) of the replaced values in
    order of place.

    A null or empty text gives '' without values. Equal values (dates: the
    same day in any layout) have equal pseudonyms in all rows. What has a shape
    but does not validate (Luhn, calendar, number ranges) stays. A column
    named ``pii`` is replaced; every row stands for itself.
    """
    # a value has a digit: texts without one are not searched
    text = text_or_empty(text_col)
    marked = (docs.drop("pii").withColumn(text_col, text)
              .withColumn("pii", F.when(F.col(text_col).rlike("[0-9]"), F.transform(
                  F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0)), lambda h: _pseudonym(h, key)))
                  .otherwise(F.array().cast("array<struct<kind:string,hit:string,new:string>>"))))
    gaps = F.split(F.col(text_col), PATTERN, -1)
    rebuilt = F.array_join(F.zip_with(gaps, F.transform("pii", lambda p: p["new"]),
                                      lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    new = F.when(F.size("pii") > 0, rebuilt).otherwise(F.col(text_col))
    return marked.withColumn(text_col, new).withColumn("pii", F.filter("pii", lambda p: p["kind"].isNotNull()))


def pseudonyms_query(spark, sf_dir: str) -> DataFrame:
    """Op 5 over ``documents``; the key of a real run is a secret of its owner."""
    from threadlens.llm.common import read

    found = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), "test key")
    count = lambda kind: F.size(F.filter("pii", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], "text")
