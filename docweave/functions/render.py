"""Docstring styles: a nested reply struct becomes text, all in array functions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLASS, QUOTE_STYLES


def _or_value(item: Column) -> Column:
    return F.when(item["name"] == "", F.lit("value")).otherwise(item["name"])


def _assumed_type(item: Column, typed: bool) -> Column:
    return item["assumed_type"] if typed else F.lit("")


class DocstringStyle:
    """Base of every style: ``render`` turns a reply struct into docstring text.

    Styles with the same settings are equal, so that their columns are built only once.
    """

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and vars(self) == vars(other)

    def __hash__(self) -> int:
        return hash(type(self))

    def render(self, data: Column, indent: Column) -> Column:
        raise NotImplementedError

    def render_typed(self, data: Column, indent: Column, definition_type: Column) -> Column:
        """As ``render``, for styles that treat classes and functions differently."""
        return self.render(data, indent)


class SectionedStyle(DocstringStyle):
    """Description, then one section for each non-empty list of items."""

    # (title, field, whether its items carry a type)
    sections: tuple[tuple[str, str, bool], ...] = ()

    def heading(self, title: str) -> str:
        raise NotImplementedError

    def item_text(self, item: Column, indent: Column, typed: bool) -> Column:
        raise NotImplementedError

    def section(self, title: str, items: Column, indent: Column, typed: bool) -> Column:
        lines = F.transform(items, lambda item: self.item_text(item, indent, typed))
        text = F.concat(F.lit(f"\n\n{self.heading(title)}\n"), F.array_join(lines, "\n"))
        return F.when(F.size(items) > 0, text).otherwise("")

    def render(self, data: Column, indent: Column) -> Column:
        parts = [self.section(title, data[name], indent, typed) for title, name, typed in self.sections]
        return F.concat(F.lit("\n"), data["description"], *parts, F.lit("\n\n"))


class GoogleStyle(SectionedStyle):
    sections = (
        ("Args", "parameters", True),
        ("Returns", "return_values", True),
        ("Raises", "exceptions", False),
    )

    def heading(self, title: str) -> str:
        return f"{title}:"

    def item_text(self, item: Column, indent: Column, typed: bool) -> Column:
        kind = _assumed_type(item, typed)
        shown = F.when(kind == "", F.lit("")).otherwise(F.concat(F.lit(" ("), kind, F.lit(")")))
        return F.concat(indent, _or_value(item), shown, F.lit(": "), item["description"])


class NumpyStyle(SectionedStyle):
    sections = (
        ("Parameters", "parameters", True),
        ("Returns", "return_values", True),
        ("Raises", "exceptions", False),
    )

    def heading(self, title: str) -> str:
        return f"{title}\n{'-' * len(title)}"

    def item_text(self, item: Column, indent: Column, typed: bool) -> Column:
        first = [indent, _or_value(item), F.lit(" : "), _assumed_type(item, typed)]
        return F.concat(*first, F.lit("\n"), indent, indent, item["description"])


class EarlyStyle(DocstringStyle):
    """The two earlier layouts: fixed indents, the type always shown, no item fallback."""

    def __init__(self, layout: str) -> None:
        if layout not in ("google_v0", "numpy_v0"):
            raise ValueError(f"unknown early layout: {layout}")
        self.google = layout == "google_v0"

    def render(self, data: Column, indent: Column) -> Column:
        def item(it: Column, typed: bool) -> Column:
            name, text = it["name"], it["description"]
            if self.google:
                shown = F.concat(F.lit(" ("), it["assumed_type"], F.lit(")")) if typed else F.lit("")
                return F.concat(F.lit("    "), name, shown, F.lit(": "), text, F.lit("\n"))
            shown = F.concat(F.lit(" : "), it["assumed_type"]) if typed else F.lit("")
            return F.concat(name, shown, F.lit("\n    "), text, F.lit("\n"))

        def section(lead: str, title: str, field: str, typed: bool) -> Column:
            head = f"{lead}{title}:\n" if self.google else f"{lead}{title}\n{'-' * len(title)}\n"
            items = data[field]
            body = F.array_join(F.transform(items, lambda it: item(it, typed)), "")
            return F.when(F.size(items) > 0, F.concat(F.lit(head), body)).otherwise(F.lit(""))

        return F.concat(
            data["description"],
            F.lit("\n\n"),
            section("", "Args" if self.google else "Parameters", "parameters", True),
            section("\n", "Returns", "return_values", True),
            section("\n", "Raises", "exceptions", False),
        )


class PythonStyle(DocstringStyle):
    """A user's ``func(data: dict, indent_char: str) -> str``, run on Arrow batches.

    In a job, the data of a class has no field but its description.
    """

    def __init__(self, func: Callable[[dict, str], str]) -> None:
        self.func = func

    def render(self, data: Column, indent: Column) -> Column:
        func = self.func

        def render_batch(data: pa.Array, indent: pa.Array) -> pa.Array:
            pairs = zip(data.to_pylist(), indent.to_pylist())
            return pa.array(
                [None if d is None else func(d, i) for d, i in pairs], type=pa.string()
            )

        return F.arrow_udf(render_batch, "string")(data, indent)

    def render_typed(self, data: Column, indent: Column, definition_type: Column) -> Column:
        only = F.struct(data["description"].alias("description"))
        of_class = F.when(definition_type == CLASS, only)
        return F.coalesce(self.render(of_class, indent), self.render(F.when(of_class.isNull(), data), indent))


def docstring_indent(suite: Column, indent: Column, col: Column, body_col: Column) -> Column:
    """White space put before every docstring line.

    A one-line definition repeats the whole default indent once per column (at least
    once); any other repeats its first character up to the body's column.
    """
    return F.when(suite, F.repeat(indent, F.greatest(col, F.lit(1)))).otherwise(
        F.repeat(F.substring(indent, 1, 1), body_col)
    )


def quote_docstring(text: Column, quote: str) -> Column:
    """Wrap in quotes so that the literal's value is exactly ``text``."""
    if quote not in QUOTE_STYLES:
        raise ValueError(f"unknown quote style {quote!r}, expected one of {QUOTE_STYLES}")
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    escaped = "".join("\\" + char for char in quote)
    body = F.replace(body, F.lit(quote), F.lit(escaped))
    if len(quote) == 1:  # such a literal cannot span lines
        body = F.replace(body, F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(quote), body, F.lit(quote))
