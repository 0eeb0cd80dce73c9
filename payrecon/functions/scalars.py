"""Scalar rules on text cells. Every function takes and returns a Column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

#: What counts as white space at the ends of a cell; SQL's trim() cuts blanks alone.
_WHITE = r"[\s\x1C-\x1F\x85\p{Z}]"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: The commonest form of a number.
_BARE = r"^-?[0-9]+(?:\.[0-9]+)?\z"
YMD8 = r"^(\d{4})(\d{2})(\d{2})$"
_YMD8_ONLY = r"^[0-9]{8}\z"
_ISO = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T].*)?$"
_MDY = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})(?:[ T].*)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row; keeps the code that Spark generates small, too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space at its ends; one whose first and last characters are printable ASCII is left alone."""
    plain = F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(plain, text).otherwise(F.regexp_replace(text, rf"^{_WHITE}+|{_WHITE}+\z", ""))


def money(number: Column) -> Column:
    """A number as an exact decimal, so that sums do not depend on the order of rows."""
    return number.cast("decimal(18,4)")


def cents(total: Column) -> Column:
    """A decimal sum, rounded to cents, as a double."""
    return F.round(total, 2).cast("double")


def same_cent(a: Column, b: Column, tolerance: float = config.CENT) -> Column:
    return F.abs(a - b) < tolerance


def to_amount(text: Column) -> Column:
    """Statement amount as a number; null for anything else. Parentheses around the whole mean minus.

    Most cells never meet the costly part: what begins with a letter is no amount, and a bare number is one as it is.
    """

    def of(cell: Column) -> Column:
        return F.when(cell < "A", F.when(cell.rlike(_NUMBER), cell.try_cast("double")).otherwise(decorated(cell)))

    def decorated(cell: Column) -> Column:
        bare = strip(F.translate(F.btrim(cell, F.lit("()")), ",$%", ""))
        sign = F.when(cell.startswith("(") & cell.endswith(")"), -1.0).otherwise(1.0)
        return let(bare, lambda x: F.when(x.rlike(_NUMBER), sign * x.try_cast("double")))

    return F.when(_worded(text), F.lit(None)).when(text.rlike(_BARE), text.try_cast("double")).otherwise(let(strip(text), of))


def _worded(text: Column) -> Column:
    """The text begins with an ASCII letter or one of the few signs between them."""
    return (text >= "A") & (text < "{")


def is_percent(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("%")), F.lit(False))


def repair_text(text: Column) -> Column:
    """Closes gaps inside parentheses and inside figures: `( 75.00 )`, `150.0 0`."""
    closed = F.regexp_replace(text, r"\(\s*(.*?)\s*\)", "($1)")
    open_ = text.rlike(rf"[(\s\x1C-\x1F\x85\p{{Z}}]")  # others have nothing to close or strip
    return F.when(open_, strip(F.regexp_replace(closed, r"(?<=[\d.,])\s+(?=[\d.,])", ""))).otherwise(text)


def to_mdy(text: Column) -> Column:
    """Any known date form as mm/dd/yyyy, times cut; "" stays, unknown or out of range is null."""
    # Year, month and day; a fourth part marks years that may have two digits.
    forms = ((YMD8, "$1|$2|$3"), (_ISO, "$1|$2|$3"), (_MDY, "$3|$1|$2|short"))

    def shown(part: Column) -> Column:
        year, month, day = (F.get(part, F.lit(i)).try_cast("int") for i in range(3))
        full = F.when(F.size(part) == 3, year).when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
        good = month.between(1, 12) & day.between(1, 31) & full.between(1900, 2200)
        return F.when(good, F.format_string("%02d/%02d/%04d", month, day, full))

    def of(cell: Column) -> Column:
        flat = F.coalesce(*[F.when(cell.rlike(p), F.regexp_replace(cell, p, order)) for p, order in forms])
        dated = (cell >= "0") & (cell < ":")  # all forms begin with a digit
        return F.when(cell == "", F.lit("")).when(dated, let(F.split(flat, r"\|"), shown))

    year, month, day = (F.substring(text, at, n) for at, n in ((1, 4), (5, 2), (7, 2)))
    good = month.between("01", "12") & day.between("01", "31") & year.between("1900", "2200")
    compact = F.when(good, F.concat_ws("/", month, day, year))
    return F.when(_worded(text), F.lit(None)).when(text.rlike(_YMD8_ONLY), compact).otherwise(let(F.coalesce(strip(text), F.lit("")), of))


def first_of_mdy(text: Column) -> Column:
    """The first component of a month-day-year text, whichever of the two it is."""
    parted = text.contains("/") | text.contains("-")
    return F.when(parted, F.regexp_extract(strip(text), _MDY, 1).try_cast("int"))


def is_ymd8(text: Column) -> Column:
    return strip(text).rlike(YMD8)


def format_amount(number: Column, decimals: int = 2) -> Column:
    return F.format_number(number, decimals)


def _stem(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, r"\.[A-Za-z]+$", ""), r"\s*\(\d+\)$", "")


def filename_amount(filename: Column) -> Column:
    """The signed amount that ends a file's name, after extension and copy number; null if there is none."""
    pattern = r"(-?)\s*([\d,]+\.\d{2})\s*$"
    stem = _stem(filename)
    value = F.replace(F.regexp_extract(stem, pattern, 2), F.lit(","), F.lit("")).try_cast("double")
    return F.when(F.regexp_extract(stem, pattern, 1) == "-", -value).otherwise(value)


def carrier_name(filename: Column) -> Column:
    """A file's name without amount, copy number and extension."""
    stem = F.regexp_replace(_stem(filename), r"[\s_-]*-?\d[\d,]*\.\d{2}$", "")
    return F.coalesce(F.nullif(F.btrim(stem, F.lit(" _-")), F.lit("")), stem)


def clean_value(value: Column, kind: Column, divisor: Column) -> Column:
    """A cell after its column's plan: dates and figures in one form, everything else as it is."""

    def of(cell: Column) -> Column:
        figure = lambda decimals: format_amount(to_amount(cell) / divisor, decimals)
        clean = F.when(kind == "date", F.nullif(to_mdy(cell), F.lit(""))).when(kind == "money", figure(2)).when(kind == "percent", figure(1))
        return F.coalesce(clean, cell)

    return let(F.coalesce(strip(value), F.lit("")), of)


def typed_cell(value: Column, header: Column) -> Column:
    """`kind, num, date, text, fmt` of a cell for a spreadsheet. Only dates with a four-digit year are dates."""
    cell = F.coalesce(strip(value), F.lit(""))
    dated = cell.rlike(r"^\d{2}/\d{2}/\d{4}$")
    day = F.when(dated, F.try_to_date(cell, "MM/dd/yyyy"))
    number = F.when(~dated, to_amount(cell))
    percent, plain = is_percent(cell), header.rlike(f"(?i){config.PERCENT_HEADER}")
    kind = F.when(day.isNotNull(), "date").when(number.isNotNull(), "number").otherwise("text")
    fmt = (
        F.when(day.isNotNull(), "mm/dd/yyyy").when(number.isNull(), F.lit(None))
        .when(percent, "0.00%").when(F.coalesce(plain, F.lit(False)), "0.00").otherwise("#,##0.00")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(percent, number / 100).otherwise(number).alias("num"),
        day.alias("date"),
        F.when(kind == "text", F.when(dated, cell).otherwise(value)).alias("text"),
        fmt.alias("fmt"),
    )


def excluded_label(text: Column) -> Column:
    """Labels of sums that are not this statement's payout."""
    return F.coalesce(text.rlike(f"(?i){config.EXCLUDED_LABEL}"), F.lit(False))


def is_total_row(text: Column, template: bool = False) -> Column:
    pattern = config.TEMPLATE_TOTAL_ROW if template else config.TOTAL_ROW
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def is_footer(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?i){config.FOOTER}"), F.lit(False))


def is_marker(value: Column, markers=config.DROP_ROW_MARKERS) -> Column:
    """The whole cell is a marker, but for case and runs of white space."""
    return F.upper(F.regexp_replace(strip(value), r"\s+", " ")).isin(*markers)


def shown_number(number: Column) -> Column:
    """A double as people write it: no exponent, at least one decimal."""
    text = F.regexp_replace(number.cast("decimal(28,8)").cast("string"), "0+$", "")
    return F.regexp_replace(text, r"\.$", ".0")


def first_true(*pairs: tuple[Column, Column]) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda w, p: w.when(*p), pairs[1:], F.when(*pairs[0]))
