"""Cleaners of single columns: Column in, Column out, all inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamworks.functions import synonyms

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
PLAIN_NUMBER = r"^([0-9]+[.]?[0-9]*|[.][0-9]+)$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
# Ratings, letter grades and months by name.
RATINGS = {"bad": 1.0, "poor": 2.0, "ok": 3.0, "average": 3.0, "good": 4.0, "excellent": 5.0}
GRADES = {"a+": 98.0, "a": 95.0, "a-": 92.0, "b+": 88.0, "b": 85.0, "b-": 82.0, "c+": 78.0, "c": 75.0, "c-": 72.0, "d+": 68.0, "d": 65.0, "d-": 62.0, "f": 0.0}
MONTHS = {"jan": "1", "feb": "2", "mar": "3", "apr": "4", "may": "5", "jun": "6", "jul": "7", "aug": "8", "sep": "9", "oct": "10", "nov": "11", "dec": "12"}


def stripped(c: Column) -> Column:
    """Without white space at both ends, of any kind that \\s holds."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def key(c: Column) -> Column:
    return F.lower(stripped(c.cast("string")))


def number(c: Column) -> Column:
    """Text to double; null unless it is a plain number (so not "4d", "nan" or "inf")."""
    s = stripped(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def price(c: Column) -> Column:
    """Amount of a price as written: its digits and dots; "free" is 0; the sign is lost; unreadable is null."""
    s = F.lower(c.cast("string"))
    digits = F.regexp_replace(F.replace(s, F.lit("approx."), F.lit("")), "[^0-9.]", "")
    return F.when(s.contains("free"), F.lit(0.0)).when(digits.rlike(PLAIN_NUMBER), digits.try_cast("double"))


def rating(c: Column) -> Column:
    """Rating word or number as a number, else null."""
    return F.coalesce(synonyms.lookup(key(c), RATINGS), number(c))


def status(c: Column, table: str = "pipe") -> Column:
    """Canonical status; an unknown one in lower case."""
    return F.coalesce(synonyms.lookup(key(c), synonyms.flat("status", table)), key(c))


def age(c: Column) -> Column:
    """Whole years from 0 to 150, else null."""
    n = number(c)
    return F.when(n.between(0, 150), n.cast("int"))


def email(c: Column) -> Column:
    """Address in lower case if well formed, else null."""
    return F.when(key(c).rlike(EMAIL), key(c))


def phone(c: Column) -> Column:
    """+ and the digits; ten digits are taken for a number of country 1; fewer than 7 or more than 15 digits are null."""
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).when(F.length(digits).between(7, 15), F.concat(F.lit("+"), digits))


def score(c: Column) -> Column:
    """Score from 0 to 100 from a percentage, a fraction, a letter grade or a number; else null."""
    s = key(c)
    percent = number(F.replace(s, F.lit("%"), F.lit("")))
    a, b = number(F.split_part(s, F.lit("/"), F.lit(1))), number(F.split_part(s, F.lit("/"), F.lit(2)))
    plain = number(s)
    return (
        F.when(s.contains("%"), F.when(percent.between(0, 100), percent))
        .when(s.contains("/"), F.when(b > 0, a / b * 100))
        .otherwise(F.coalesce(synonyms.lookup(s, GRADES), F.when(plain.between(0, 100), plain)))
    )


def date(c: Column) -> Column:
    """YYYY-MM-DD of a date in one of these forms, else null.

    Y-M-D with -, / or . (a time may follow), D.M.Y, M/D/Y and M-D-Y (D first if the first number is over 12),
    "Mon D, Y", "D Mon Y" with English months.
    """
    s = F.lower(stripped(c.cast("string")))
    iso, german, slash = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})([ t].*)?$", r"^([0-9]{1,2})[.]([0-9]{1,2})[.]([0-9]{4})$", r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})$"
    named, named_day = r"^([a-z]{3})[a-z]*[.]? +([0-9]{1,2}),? +([0-9]{4})$", r"^([0-9]{1,2})[.]? +([a-z]{3})[a-z]*[.]?,? +([0-9]{4})$"
    part = lambda p, k: F.regexp_extract(s, p, k)
    month = lambda p, k: synonyms.lookup(part(p, k), MONTHS)
    text = lambda y, m, d: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    first_is_day = F.when(part(slash, 1) != "", part(slash, 1).cast("int") > 12)
    built = (
        F.when(s.rlike(iso), text(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(s.rlike(german), text(part(german, 3), part(german, 2), part(german, 1)))
        .when(s.rlike(slash), F.when(first_is_day, text(part(slash, 3), part(slash, 2), part(slash, 1))).otherwise(text(part(slash, 3), part(slash, 1), part(slash, 2))))
        .when(s.rlike(named), text(part(named, 3), month(named, 1), part(named, 2)))
        .when(s.rlike(named_day), text(part(named_day, 3), month(named_day, 2), part(named_day, 1)))
    )
    return F.date_format(built.try_cast("date"), "yyyy-MM-dd")


def identifier(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def categorical(c: Column, kind: str, table: str = "policy") -> Column:
    """Canonical value of a known spelling; other values as they are."""
    return F.coalesce(synonyms.lookup(F.lower(F.trim(c)), synonyms.flat(kind, table)), c)


def standard_case(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def boolean(c: Column) -> Column:
    """true, 1, yes, y and false, 0, no, n as a boolean; else null."""
    k = key(c)
    return F.when(k.isin("true", "1", "yes", "y"), F.lit(True)).when(k.isin("false", "0", "no", "n"), F.lit(False))


#: Cleaners by the exact lower-case name of a column; users may add their own.
SPECIAL: dict[str, Callable[[Column], Column]] = {"price": price, "rating": rating, "status": status, "date": date, "order_date": date, "visit_date": date, "age": age, "email": email, "phone": phone, "score": score}


def special_cleaner(name: str) -> Callable[[Column], Column] | None:
    return SPECIAL.get(name.strip().lower())
