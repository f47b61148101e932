"""Cut definitions out of modules and put docstrings into them.

A module is an array of line slots, one per physical line, each holding the pieces of
text now found there. Lines joined by one token live in the slot of the first; inserted
lines live in the slot of the header they follow. Line numbers therefore stay valid, a
module is parsed once, and every step below is linear in the module's size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lets import let
from ..functions.text import WHITESPACE

END = 2**31 - 1


def _replace_slots(
    items: Column, cuts: Column, first: str, last: str, keep, replacement
) -> Column:
    """Replace the items ``first..last`` of every (sorted, disjoint) cut."""

    def before(cut: Column, index: Column) -> Column:
        start = F.when(index == 0, F.lit(0)).otherwise(F.get(cuts, index - 1)[last]) + 1
        return F.slice(items, start, cut[first] - start)

    pieces = F.flatten(
        F.transform(cuts, lambda cut, i: F.concat(keep(before(cut, i)), replacement(cut)))
    )
    tail_start = F.element_at(cuts, -1)[last] + 1
    tail = F.slice(items, tail_start, F.greatest(F.size(items) - tail_start + 1, F.lit(0)))
    untouched = keep(items)
    return F.when(F.coalesce(F.size(cuts), F.lit(0)) <= 0, untouched).otherwise(
        F.concat(pieces, keep(tail))
    )


def line_slots(code: Column, spans: Column) -> Column:
    """``ARRAY<ARRAY<STRING>>``: the pieces of text of each physical line."""
    empty = F.array().cast("array<string>")

    def joined(lines: Column):
        def build(span: Column) -> Column:
            count = span["last"] - span["first"]
            text = F.array_join(F.slice(lines, span["first"], count + 1), "\n")
            return F.concat(F.array(F.array(text)), F.array_repeat(empty, count))

        return build

    return let(
        F.split(code, "\n", -1),
        lambda lines: _replace_slots(
            lines,
            spans,
            "first",
            "last",
            keep=lambda part: F.transform(part, lambda line: F.array(line)),
            replacement=joined(lines),
        ),
    )


def definition_text(slots: Column, definition: Column) -> Column:
    """A definition's own text, moved to the left margin.

    Only the start of each piece is un-indented: the inner lines of strings stay as they are.
    """
    indent = definition["def_indent"]
    count = definition["text_end_line"] - definition["text_line"] + 1
    pieces = F.flatten(F.slice(slots, definition["text_line"], count))
    moved = F.transform(
        pieces,
        lambda piece: F.when(
            F.startswith(piece, indent), piece.substr(F.length(indent) + 1, F.lit(END))
        ).otherwise(piece),
    )
    return F.array_join(F.when(indent == "", pieces).otherwise(moved), "\n")


def edit_of(definition: Column, docstring: Column) -> Column:
    """The change one quoted docstring makes to its module."""
    return F.struct(
        F.when(definition["suite"], definition["suite_line"])
        .otherwise(definition["header_end_line"])
        .alias("slot"),
        definition["suite"].alias("suite"),
        definition["suite_offset"].alias("offset"),
        definition["body_indent"].alias("indent"),
        definition["single_line"].alias("single_line"),
        docstring.alias("docstring"),
    )


def apply_edits(slots: Column, edits: Column) -> Column:
    """Slots with the docstrings of ``edits`` (sorted by slot) put in.

    Below a header: docstring, then an empty line. Where the body shares the header's
    line: it moves to a line of its own below both, followed by an empty line.
    """

    def replacement(edit: Column) -> Column:
        pieces = F.get(slots, edit["slot"] - 1)
        indent = edit["indent"]
        added = F.array(F.concat(indent, edit["docstring"]), indent)
        text = F.get(pieces, F.lit(0))
        # The header ends in a colon; a backslash after it only joined the lines.
        header = F.rtrim(F.left(text, edit["offset"]), F.lit(WHITESPACE + "\\"))
        body = F.concat(indent, text.substr(edit["offset"] + 1, F.lit(END)))
        split = F.concat(
            F.array(header),
            added,
            F.array(body),
            F.when(edit["single_line"], F.array(indent)).otherwise(
                F.array().cast("array<string>")
            ),
        )
        return F.array(F.when(edit["suite"], split).otherwise(F.concat(pieces, added)))

    return _replace_slots(
        slots, edits, "slot", "slot", keep=lambda part: part, replacement=replacement
    )


def join_slots(slots: Column) -> Column:
    return F.array_join(F.flatten(slots), "\n")


def rewritten_code(code: Column, spans: Column, edits: Column) -> Column:
    """Complete new source text of a module."""
    return F.when(F.coalesce(F.size(edits), F.lit(0)) <= 0, code).otherwise(
        let(line_slots(code, spans), lambda slots: join_slots(apply_edits(slots, edits)))
    )
