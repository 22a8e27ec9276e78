"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms and forms that must be just these for results to agree.

#: Values that stand for a missing one.
MISSING = (
    "MISSING", "UNDEFINED", "undefined", "missing", "none", "nan", "empty", "empties", "unknown", "other", "others", "na", "nil", "null", "", " ", "<unknown>", "0;n/a", "NIL",
)
#: Forms of dates that are searched for in a value: year first anywhere, and whole values with the day, year, day or month first.
DATE_FORMS = (
    r'([0-9]{4})[\.\/\-]([0-9]{1,2})[\.\/\-]([0-9]{1,2})',
    r'^(?=\d)(?:(?!(?:(?:0?[5-9]|1[0-4])(?:\.|-|\/)10(?:\.|-|\/)(?:1582))|(?:(?:0?[3-9]|1[0-3])(?:\.|-|\/)0?9(?:\.|-|\/)(?:1752)))(31(?!(?:\.|-|\/)(?:0?[2469]|11))|30(?!(?:\.|-|\/)0?2)|(?:29(?:(?!(?:\.|-|\/)0?2(?:\.|-|\/))|(?=\D0?2\D(?:(?!000[04]|(?:(?:1[^0-6]|[2468][^048]|[3579][^26])00))(?:(?:(?:\d\d)(?:[02468][048]|[13579][26])(?!\x20BC))|(?:00(?:42|3[0369]|2[147]|1[258]|09)\x20BC))))))|2[0-8]|1\d|0?[1-9])([-.\/])(1[012]|(?:0?[1-9]))\2((?=(?:00(?:4[0-5]|[0-3]?\d)\x20BC)|(?:\d{4}(?:$|(?=\x20\d)\x20)))\d{4}(?:\x20BC)?)(?:$|(?=\x20\d)\x20))?((?:(?:0?[1-9]|1[012])(?::[0-5]\d){0,2}(?:\x20[aApP][mM]))|(?:[01]\d|2[0-3])(?::[0-5]\d){1,2})?$',
    r'^(?:(?:(?:(?:(?:1[6-9]|[2-9]\d)?(?:0[48]|[2468][048]|[13579][26])|(?:(?:16|[2468][048]|[3579][26])00)))(\/|-|\.)(?:0?2\1(?:29)))|(?:(?:(?:1[6-9]|[2-9]\d)?\d{2})(\/|-|\.)(?:(?:(?:0?[13578]|1[02])\2(?:31))|(?:(?:0?[1,3-9]|1[0-2])\2(29|30))|(?:(?:0?[1-9])|(?:1[0-2]))\2(?:0?[1-9]|1\d|2[0-8]))))$',
    r'^(((0?[1-9]|[12]\d|3[01])[\.\-\/](0?[13578]|1[02])[\.\-\/]((1[6-9]|[2-9]\d)?\d{2}))|((0?[1-9]|[12]\d|30)[\.\-\/](0?[13456789]|1[012])[\.\-\/]((1[6-9]|[2-9]\d)?\d{2}))|((0?[1-9]|1\d|2[0-8])[\.\-\/]0?2[\.\-\/]((1[6-9]|[2-9]\d)?\d{2}))|(29[\.\-\/]0?2[\.\-\/]((1[6-9]|[2-9]\d)?(0[48]|[2468][048]|[13579][26])|((16|[2468][048]|[3579][26])00)|00)))$',
    r'^([0]?[1-9]|[1][0-2])[./-]([0]?[1-9]|[1|2][0-9]|[3][0|1])[./-]([0-9]{4}|[0-9]{2})$',
)
#: Words for characters that a LaTeX command name can't hold.
LATEX_WORDS = (("0", "Zero"), ("1", "One"), ("2", "Two"), ("3", "Three"), ("4", "Four"), ("5", "Five"), ("6", "Six"), ("7", "Seven"), ("8", "Eight"), ("9", "Nine"), (".", "Point"))


def num_to_letters(n: Column, lowercase: bool = False, digits: int = 7) -> Column:
    """A number from 0 as a bijective base-26 word: 0 is A, 25 Z, 26 AA. Numbers up to 26**digits; null stays null."""
    first, value, out = ord("a" if lowercase else "A"), n.cast("long") + 1, []
    for place in range(digits - 1, -1, -1):
        least = sum(26**i for i in range(place + 1))  # the smallest number with a letter at this place
        out.append(F.when(value >= least, F.chr(F.pmod(F.floor((value - least) / 26**place), F.lit(26)) + first)).otherwise(F.lit("")))
    return F.when(n.isNotNull(), F.concat(*out))


def row_key(*columns: str, null: str = "nan") -> Column:
    """Values joined by '|', nulls by name; nothing is escaped."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns])


def escaped(c: Column, null: str = "__NA__") -> Column:
    """A value with its separators escaped; null has a name of its own."""
    out = F.regexp_replace(c.cast("string"), r"\\", r"\\\\")
    for mark in ("|", "="):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return F.coalesce(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit(null))


def level_path(levels: list[list[str]], null: str = "__NA__") -> Column:
    """For each level 'column=value|column=value' of the columns that are not null; a name for none."""
    each = []
    for columns in levels:
        parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), escaped(F.col(c)))) for c in columns]
        joined = F.concat_ws("|", *parts)
        each.append(F.when(joined == "", F.lit(null)).otherwise(joined))
    return F.array(*each)


def camel_to_white(c: Column) -> Column:
    c = F.regexp_replace(c, "(.)([A-Z][a-z]+)", "$1 $2")
    return F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")


def clean_label(c: Column) -> Column:
    """A label in lower-case words: 'nan' goes wherever it stands, camel case is split, all but letters become blanks."""
    c = F.lower(camel_to_white(F.replace(c, F.lit("nan"), F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z]", " "), " +", " "))


def has_date(c: Column) -> Column:
    out = F.lit(False)
    for form in DATE_FORMS:
        out = out | c.rlike(form)
    return out


def numbers(c: Column) -> Column:
    """'[1, 2]' or '3' as an array of numbers; null for anything else."""
    text = F.trim(c)
    return F.when(text.rlike(r"^\[.*\]$"), F.from_json(text, "array<bigint>")).when(text.rlike(r"^[+-]?\d+$"), F.array(text.cast("long")))


def event_tuple(*columns: str, missing: tuple[str, ...] = MISSING) -> Column:
    """Values joined by '*#*' without missing ones. What is tested is the value itself: a null is no term, and stays as 'nan'."""
    each = F.array(*[F.when(F.col(c).isNull(), F.lit("nan")).when(~F.col(c).cast("string").isin(*missing), F.col(c).cast("string")) for c in columns])
    return F.array_join(each, "*#*")


def value_tuple(*columns: str, missing: tuple[str, ...] = MISSING) -> Column:
    """Values as an array without missing ones, nulls among them."""
    return F.filter(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: x.isNotNull() & ~x.isin(*missing))


def split_element_action(c: Column) -> tuple[Column, Column]:
    """'element12action' as its element, letters and digits, and the rest."""
    form = "([A-Za-z]+[0-9]+)(.*)"
    return F.nullif(F.regexp_extract(c, form, 1), F.lit("")), F.when(c.rlike(form), F.regexp_extract(c, form, 2))


def latex_name(c: Column) -> Column:
    """A name with digits and dots spelled out, and the parts between underscores each with a capital first letter; the rest stays as it is."""
    c = F.replace(c, F.lit("filtered"), F.lit("Filtered"))
    for mark, word in LATEX_WORDS:
        c = F.replace(c, F.lit(mark), F.lit(word))
    parts = F.filter(F.split(c, "_"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def bounds(c: Column) -> Column:
    """Smallest and largest of an array; null if it is empty."""
    return F.when(F.size(c) > 0, F.struct(F.array_min(c).alias("start"), F.array_max(c).alias("end")))
