"""Text cleaning as column expressions (they match Python's ``str`` methods)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: the line breaks of Python's str.splitlines, and the stock openings
# --- removed from a description (first match only, case-sensitive).
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
STOCK_PREFIXES = ("This function", "This method", "This class")
# --- End of fixed values.

# Everything Python's str.strip takes for white space; line breaks are part of it.
WHITESPACE = "".join(char for char in map(chr, range(0x3001)) if char.isspace())

OUTPUT_PREFIX = "modified_"


def _class(chars: str) -> str:
    return "[" + "".join(f"\\u{ord(char):04x}" for char in chars) + "]"


ANY_LINE_BREAK = r"\r\n|" + _class(LINE_BREAKS)
# From the first to the last line break of a stretch of white space.
_BLANK_LINES = f"{_class(LINE_BREAKS)}(?:{_class(WHITESPACE)}*{_class(LINE_BREAKS)})?"


def strip(text: Column) -> Column:
    """``str.strip()``; by default ``trim`` would remove only the space character."""
    return F.trim(text, F.lit(WHITESPACE))


def indent_lines(text: Column, indent: Column) -> Column:
    """Put ``indent`` (white space) before each of ``str.splitlines()``, joined by ``\\n``.

    ``text`` is used several times: make it a column of its own first, which the optimizer then
    keeps. A ``let`` would take the whole expression out of generated code.
    """
    last = F.right(text, F.lit(1))
    ends = F.when(text.endswith("\r\n"), 2).when(F.instr(F.lit(LINE_BREAKS), last) > 0, 1).otherwise(0)
    body = F.left(text, F.length(text) - ends)
    start = F.concat(F.lit("\n"), indent)
    usual = F.replace(body, F.lit("\n"), start)
    other = F.regexp_replace(body, F.lit(ANY_LINE_BREAK), start)
    return F.concat(indent, F.when(body.rlike(_class(LINE_BREAKS[1:])), other).otherwise(usual))


def strip_blank_lines(text: Column) -> Column:
    """Drop blank lines, then trim the whole text."""
    return strip(F.regexp_replace(text, _BLANK_LINES, "\n"))


def remove_stock_prefix(text: Column) -> Column:
    rest = text
    for prefix in STOCK_PREFIXES:
        cut = text.substr(len(prefix) + 1, 2**31 - 1)
        rest = F.when(text.startswith(prefix), cut).otherwise(rest)
    return rest


def capitalize_first(text: Column) -> Column:
    """Trim, then upper-case the first character and keep the rest as it is."""
    stripped = strip(text)
    return F.concat(F.upper(F.left(stripped, F.lit(1))), stripped.substr(2, 2**31 - 1))


def tidy_description(text: Column) -> Column:
    """A reply's description as it is printed; empty means the definition is skipped."""
    return capitalize_first(remove_stock_prefix(text))


def postprocess(data: Column) -> Column:
    return data.withField("description", tidy_description(data["description"]))


def output_path(path: Column, inplace: bool = False) -> Column:
    """The same path, or a sibling whose base name has a prefix."""
    if inplace:
        return path
    return F.regexp_replace(path, "([^/]+)$", OUTPUT_PREFIX + "$1")


def token_count(text: Column) -> Column:
    """Estimated tokens: words and single punctuation marks.

    The job's ``token_count`` option takes any other function from a text column to a count, a
    pandas UDF around an exact tokenizer for instance.
    """
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def normalise_code(text: Column) -> Column:
    """Source text as a text-mode read gives it: no byte-order mark, ``\\n`` line ends."""
    unmarked = F.when(text.startswith("\ufeff"), text.substr(2, 2**31 - 1)).otherwise(text)
    return F.replace(F.replace(unmarked, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
