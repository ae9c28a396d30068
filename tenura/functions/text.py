"""Column-level scalar functions (all JVM-side expressions, no Python UDFs).

Every helper takes and returns ``Column`` objects, so the same expression is
used for a single literal query and for a whole table of requests, and stays
inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Macron vowels and their plain equivalents (same positions).
MACRON_FROM = "āēīōūĀĒĪŌŪ"
MACRON_TO = "aeiouAEIOU"

# Road-type words dropped from the end of an address query.
ROAD_TYPE_SUFFIXES = (
    "road", "street", "avenue", "drive", "place", "crescent", "lane",
    "way", "court", "close", "terrace", "boulevard", "highway", "parade",
    "grove", "rise", "rd", "st", "ave", "dr", "pl", "cr", "ln",
)

# Accepted key text — 1 to 100 characters, none of NUL, LF, CR,
# single quote, double quote or backslash.
VALID_KEY_PATTERN = "^[^\\x00\\n\\r'\"\\\\]{1,100}$"

# End-of-lifecycle spellings that mean "still open".
OPEN_END_VALUES = ("", "00000000", "0000-00-00")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_text(col) -> Column:
    """Macron folding + lower case.

    Decomposed input (vowel + U+0304 combining macron) folds the same way as the
    precomposed form, which is what NFC-then-translate gives for these vowels.
    """
    c = _c(col)
    # the regular expression only runs on text that holds a combining macron
    c = F.when(F.instr(c, "\u0304") > 0, F.regexp_replace(c, "([aeiouAEIOU])\u0304", "$1")).otherwise(c)
    return F.lower(F.translate(c, MACRON_FROM, MACRON_TO))


def join_parts(sep: str, *cols) -> Column:
    """Join the non-NULL parts with ``sep``, trim, empty -> NULL."""
    return F.nullif(F.trim(F.concat_ws(sep, *[_c(c) for c in cols])), F.lit(""))


def party_name(ptype, other, surname, suffix=None) -> Column:
    """Individual -> joined name parts; corporate -> surname field; else NULL."""
    parts = [_c(other), _c(surname)] + ([_c(suffix)] if suffix is not None else [])
    return (F.when(_c(ptype) == "INDV", F.trim(F.concat_ws(" ", *parts)))
             .when(_c(ptype) == "CORP", _c(surname)))


def street_no(num, high, sfx) -> Column:
    """``num/high`` for ranges, ``num`` + suffix glued, else ``num`` (NULL-propagating)."""
    num, high, sfx = _c(num), _c(high), _c(sfx)
    return (F.when(high.isNotNull(), F.concat(num, F.lit("/"), high))
             .when(sfx.isNotNull(), F.concat(num, sfx))
             .otherwise(num))


def code_label(description, code) -> Column:
    """Description when known, else the raw code."""
    return F.coalesce(_c(description), _c(code))


def code_label_case(code, mapping: dict[str, str]) -> Column:
    """Literal CASE mapping with the raw code as the fallback."""
    c = _c(code)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return c if expr is None else expr.otherwise(c)


def type_code(grp, typ) -> Column:
    """``grp-type`` skipping NULL parts."""
    return F.concat_ws("-", _c(grp), _c(typ))


def file_name(path) -> Column:
    """Last element of a path."""
    return F.regexp_extract(_c(path), r"([^/]+)$", 1)


def file_entity(name, n: int = 3, sep: str = "-") -> Column:
    """N-th ``sep`` token of a file name (1-based), '' when absent."""
    return F.split_part(_c(name), F.lit(sep), F.lit(n))


def any_contains(cols, text) -> Column:
    """OR of literal-substring tests (``text`` may be a literal or a Column)."""
    t = text if isinstance(text, Column) else F.lit(text)
    return reduce(lambda a, b: a | b, [_c(c).contains(t) for c in cols])


def parse_address_query(q) -> Column:
    """Parse an address query column into a struct.

    Fields: ``norm`` (folded text), ``spaced`` (space at each digit-letter
    boundary), ``num``/``unit``/``road`` when the text looks like ``43a road
    name`` (else NULL), and ``road_name`` = road without a trailing road-type word
    when the road has more than one word.
    """
    norm = fold_text(q)
    spaced = F.regexp_replace(norm, r"(\d)([a-z])", "$1 $2")
    pat = r"^(\d+)\s*([a-z])\s+(.+)$"
    matched = norm.rlike(pat)
    num = F.when(matched, F.regexp_extract(norm, pat, 1))
    unit = F.when(matched, F.regexp_extract(norm, pat, 2))
    road = F.when(matched, F.regexp_extract(norm, pat, 3))
    words = F.split(F.trim(road), r"\s+")
    n = F.size(words)
    last = F.element_at(words, -1)
    road_name = (F.when(road.isNull(), F.lit(None).cast("string"))
                  .when((n > 1) & last.isin(*ROAD_TYPE_SUFFIXES),
                        F.array_join(F.slice(words, 1, n - 1), " "))
                  .otherwise(road))
    return F.struct(norm.alias("norm"), spaced.alias("spaced"), num.alias("num"),
                    unit.alias("unit"), road.alias("road"), road_name.alias("road_name"))


def valid_key(col) -> Column:
    """Key validity test."""
    return F.coalesce(_c(col).rlike(VALID_KEY_PATTERN), F.lit(False))


def split_list(col, sep: str = ",") -> Column:
    """Separated list -> array without blank items."""
    return F.filter(F.split(_c(col), sep), lambda x: x != "")


def first_sorted(col) -> Column:
    """X11: smallest element of an array, NULL on empty (no error under ANSI)."""
    return F.try_element_at(F.sort_array(_c(col)), F.lit(1))


def non_null_items(col) -> Column:
    """X11: drop NULL items of an array."""
    return F.filter(_c(col), lambda x: x.isNotNull())
