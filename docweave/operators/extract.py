"""Definition extraction: each module becomes rows of functions and classes.

Parsing is the one stage Spark has no expression for. ``module_facts`` sees one module
at a time and returns positions only; every text is cut out later by array functions.
"""

from __future__ import annotations

import ast
import gc
import io
import re
import tokenize
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schema import CLASS, DEFINITION, FUNCTION, MODULE

FALLBACK_INDENT = "    "
_LAYOUT = {
    tokenize.NEWLINE, tokenize.NL, tokenize.COMMENT, tokenize.INDENT, tokenize.DEDENT,
}
_ENDS = _LAYOUT | {tokenize.ENDMARKER}
_BLOCKS = {"body", "handlers", "cases", "orelse", "finalbody"}
_FSTRING_START = getattr(tokenize, "FSTRING_START", -1)
_FSTRING_END = getattr(tokenize, "FSTRING_END", -1)
# All that says where the lines of a valid module end: comments, strings, brackets and line breaks.
_MARKS = re.compile(
    r"""\#[^\n]*|(?P<prefix>(?<!\w)[A-Za-z]{1,2})?(?:"{3}[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"{3}"""
    r"""|'{3}[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'{3}|"[^"\\\n]*(?:\\.[^"\\\n]*)*\""""
    r"""|'[^'\\\n]*(?:\\.[^'\\\n]*)*')|[()\[\]{}\n\\]""",
    re.DOTALL,
)


class _Layout:
    """What the token stream tells about a module's lines."""

    def __init__(self, code: str) -> None:
        self.lines = code.split("\n")
        self.indent = ""
        self.logical_ends: list[int] = []  # rows that end a logical line
        self.strings: list[tuple[int, int]] = []
        self.dedents: set[int] = set()
        self.spans: list[list[int]] = []
        if not self._scan(code):
            self.indent, self.logical_ends, self.strings, self.dedents, self.spans = "", [], [], set(), []
            self._tokenize(code)
        self.indent = self.indent or FALLBACK_INDENT
        self.inner = {n for first, last in self.spans for n in range(first + 1, last + 1)}

    def _scan(self, code: str) -> bool:
        """Read the layout off ``_MARKS``, several times faster than token by token.

        False for what needs all tokens: formatted strings, lines joined by a backslash, form feeds.
        """
        if "\f" in code:
            return False
        row, start, depth, inside, indents = 1, 0, 0, False, [0]
        self._open(row, indents)
        for mark in _MARKS.finditer(code):
            text = mark.group()
            if text == "\n":
                if depth == 0 and (inside or not self._is_blank(row)):
                    self.logical_ends.append(row)
                    inside = False
                elif depth:
                    inside = True
                row, start = row + 1, mark.end()
                if depth == 0 and not inside:
                    self._open(row, indents)
            elif text in "([{":
                depth += 1
            elif text in ")]}":
                depth -= 1
            elif text == "\\":
                return False
            elif text[0] != "#":
                prefix = set((mark["prefix"] or "").lower())
                if prefix & {"f", "t"}:
                    return False
                # Other letters are a word that ends where the string begins.
                at = mark.start() if prefix <= {"r", "b", "u"} else mark.end("prefix")
                self.strings.append((row, at - start))
                if "\n" in text:
                    last = row + text.count("\n")
                    self._join(row, last)
                    row, start, inside = last, mark.start() + text.rindex("\n") + 1, True
        if start < len(code) and (inside or not self._is_blank(row)):
            self.logical_ends.append(row)
        return True

    def _is_blank(self, row: int) -> bool:
        text = self.lines[row - 1].lstrip()
        return not text or text[0] == "#"

    def _open(self, row: int, indents: list[int]) -> None:
        """Where a logical line may begin: note if it is deeper or less deep than the one before."""
        line = self.lines[row - 1]
        text = line.lstrip()
        if not text or text[0] == "#":
            return
        leading = line[: len(line) - len(text)]
        width = len(leading.expandtabs(8))
        if width > indents[-1]:
            indents.append(width)
            self.indent = self.indent or leading
        while width < indents[-1]:
            indents.pop()
            self.dedents.add(row)

    def _tokenize(self, code: str) -> None:
        fstrings: list[int] = []
        last_kind, last_row = tokenize.NL, 0
        for kind, text, start, end, _ in tokenize.generate_tokens(io.StringIO(code).readline):
            if kind == _FSTRING_START:
                fstrings.append(start[0])
            elif kind == _FSTRING_END:
                self._join(fstrings.pop(), end[0])
            elif fstrings:
                pass
            elif kind == tokenize.STRING:
                self.strings.append(start)
                self._join(start[0], end[0])
            elif kind == tokenize.NEWLINE:
                self.logical_ends.append(start[0])
            elif kind == tokenize.INDENT:
                self.indent = self.indent or text
            elif kind == tokenize.DEDENT:
                self.dedents.add(start[0])
            if last_row != start[0] and last_kind not in _LAYOUT and kind not in _ENDS:
                self._join(last_row, start[0])  # a backslash joins the lines
            last_kind, last_row = kind, end[0]

    def _join(self, first: int, last: int) -> None:
        if first == last:
            return
        if self.spans and first <= self.spans[-1][1]:
            self.spans[-1][0] = min(first, self.spans[-1][0])
            self.spans[-1][1] = max(last, self.spans[-1][1])
        else:
            self.spans.append([first, last])

    def chars(self, row: int, byte_offset: int) -> int:
        line = self.lines[row - 1]
        if line.isascii():
            return byte_offset
        return len(line.encode()[:byte_offset].decode())

    def leading(self, row: int) -> str:
        line = self.lines[row - 1]
        return line[: len(line) - len(line.lstrip())]

    def is_filler(self, row: int) -> bool:
        text = self.lines[row - 1].strip()
        return (not text or text[0] == "#") and row not in self.inner

    def slot(self, row: int, offset: int) -> tuple[int, int]:
        """The line slot a position falls into once joined lines share one slot."""
        while row in self.inner:
            row -= 1
            offset += len(self.lines[row - 1]) + 1
        return row, offset

    def own_comments_start(self, first: int, indent: str) -> int:
        """First comment line that belongs to the definition starting at ``first``."""
        row, start = first - 1, first
        while row >= 1 and self.is_filler(row):
            if self.lines[row - 1].strip():
                deeper = len(self.leading(row)) > len(indent)
                if deeper and first in self.dedents:
                    break  # closes the block above
                start = row
            row -= 1
        # Comments above a module's first statement belong to the module.
        return first if row == 0 else start

    def own_comments_end(self, end: int, body_indent: str) -> int:
        row, last = end + 1, end
        while row <= len(self.lines) and self.is_filler(row):
            line = self.lines[row - 1]
            if line.strip() and line.startswith(body_indent):
                last = row
            row += 1
        return last


def _has_docstring(layout: _Layout, first: ast.stmt) -> bool:
    """A statement line of its own that opens with one plain string or bytes literal."""
    value = getattr(first, "value", None)
    if not isinstance(first, ast.Expr) or not isinstance(value, ast.Constant):
        return False
    if not isinstance(value.value, (str, bytes)):
        return False
    start = (value.lineno, layout.chars(value.lineno, value.col_offset))
    end = (value.end_lineno, layout.chars(value.end_lineno, value.end_col_offset))
    following = bisect_left(layout.strings, start) + 1
    return following >= len(layout.strings) or layout.strings[following] >= end


def _definition(layout: _Layout, node: ast.stmt, depth: int) -> dict:
    first = node.body[0]
    col = layout.chars(node.lineno, node.col_offset)
    header_end = layout.logical_ends[bisect_left(layout.logical_ends, node.lineno)]
    body_col = layout.chars(first.lineno, first.col_offset)
    suite = first.lineno <= header_end
    slot, offset = layout.slot(first.lineno, body_col)
    def_indent = layout.leading(node.lineno)
    if suite:
        body_indent = def_indent + layout.indent
    else:
        body_line = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
        body_indent = layout.leading(body_line)
    top = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    return {
        "name": node.name,
        "kind": CLASS if isinstance(node, ast.ClassDef) else FUNCTION,
        "is_async": isinstance(node, ast.AsyncFunctionDef),
        "depth": depth,
        "line": node.lineno,
        "end_line": node.end_lineno,
        "col": col,
        "header_end_line": header_end,
        "body_line": first.lineno,
        "body_col": body_col,
        "suite": suite,
        "suite_line": slot,
        "suite_offset": offset,
        "single_line": node.lineno == node.end_lineno,
        "has_docstring": not suite and _has_docstring(layout, first),
        "text_line": layout.own_comments_start(top, def_indent),
        "text_end_line": (
            node.end_lineno if suite else layout.own_comments_end(node.end_lineno, body_indent)
        ),
        "def_indent": def_indent,
        "body_indent": body_indent,
    }


def _nested(node: ast.AST) -> list[ast.AST]:
    """Statements directly inside a statement; definitions occur nowhere else."""
    inside: list[ast.AST] = []
    for name in node._fields:
        if name in _BLOCKS and isinstance(value := getattr(node, name), list):
            inside.extend(value)
    return inside


def module_facts(code: str, skip_init: bool = True) -> dict:
    """Indent, joined lines and definitions (outer before inner) of one module."""
    tree = ast.parse(code)
    found: list[tuple[ast.stmt, int, int]] = []  # node, depth, index of enclosing definition
    stack: list[tuple[ast.AST, int, int]] = [(tree, 0, -1)]
    while stack:
        node, depth, owner = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            found.append((node, depth, owner))
            depth, owner = depth + 1, len(found) - 1
        stack.extend((child, depth, owner) for child in reversed(_nested(node)))
    if not found:
        return {"indent": FALLBACK_INDENT, "spans": [], "defs": [], "error": None}

    layout = _Layout(code)
    defs = [_definition(layout, node, depth) for node, depth, _ in found]
    # A definition waits for every undocumented one inside it.
    waits = [0] * len(defs)
    for index in range(len(defs) - 1, -1, -1):
        item, owner, wait = defs[index], found[index][2], waits[index]
        skipped = skip_init and item["kind"] == FUNCTION and item["name"] == "__init__"
        wanted = not item["has_docstring"] and not skipped
        item["level"] = wait if wanted else -1
        if owner >= 0:
            waits[owner] = max(waits[owner], wait + 1 if wanted else wait)
    spans = [{"first": first, "last": last} for first, last in layout.spans]
    return {"indent": layout.indent, "spans": spans, "defs": defs, "error": None}


def safe_module_facts(code: str | None, skip_init: bool = True) -> dict:
    """As ``module_facts``; a module that cannot be parsed yields only its error."""
    try:
        if code is None:
            raise ValueError("source is not valid UTF-8")
        return module_facts(code, skip_init)
    except Exception as exc:  # one bad file must never fail the others
        return {"indent": None, "spans": None, "defs": None, "error": f"{type(exc).__name__}: {exc}"}


def facts_array(facts: list[dict], arrow_type: pa.StructType) -> pa.Array:
    """``facts`` as an Arrow array: a field at a time, which is much faster than a row at a time."""

    def structs(rows: list[dict], kind: pa.StructType) -> pa.Array:
        columns = [pa.array([row[f.name] for row in rows], type=f.type) for f in kind]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    columns = []
    for field in arrow_type:
        values = [fact[field.name] for fact in facts]
        if not pa.types.is_list(field.type):
            columns.append(pa.array(values, type=field.type))
            continue
        ends, flat = [0], []
        for rows in values:
            flat.extend(rows or ())
            ends.append(len(flat))
        missing = pa.array([rows is None for rows in values], type=pa.bool_())
        columns.append(
            pa.ListArray.from_arrays(
                pa.array(ends, type=pa.int32()), structs(flat, field.type.value_type), type=field.type, mask=missing
            )
        )
    return pa.StructArray.from_arrays(columns, fields=list(arrow_type))


def parse_modules(files: DataFrame, skip_init: bool = True) -> DataFrame:
    """``(path, code, …)`` plus ``indent``, ``spans``, ``defs`` and ``error``, a row per file."""
    arrow_type = to_arrow_type(MODULE)

    def parse_batch(code: pa.Array) -> pa.Array:
        gc.disable()  # trees have no cycles; looking for some takes as long as parsing
        try:
            return facts_array([safe_module_facts(text, skip_init) for text in code.to_pylist()], arrow_type)
        finally:
            gc.enable()

    # Marked nondeterministic so that later filters do not run the parser a second time.
    parse = F.arrow_udf(parse_batch, MODULE).asNondeterministic()
    return files.withColumn("_module", parse("code")).select(*files.columns, "_module.*")


def definition_id(path: Column, definition: Column) -> Column:
    return F.concat_ws(":", path, definition["line"], definition["col"])


def explode_definitions(parsed: DataFrame, text: bool = True) -> DataFrame:
    """One row per definition, with its exact source lines as ``definition`` if ``text``.

    Without, no code is read, split or copied: positions and flags are all there is.
    """
    from .splice import definition_text, line_slots
    from ..functions.lets import let

    if not text:
        rows = parsed.select("path", F.explode("defs").alias("d"))
        fields = [F.col(f"d.{name}").alias(name) for name in DEFINITION.fieldNames()]
        return rows.select(
            "path",
            definition_id(F.col("path"), F.col("d")).alias("def_id"),
            F.col("d.kind").alias("definition_type"),
            *fields,
        )
    with_text = let(
        line_slots(F.col("code"), F.col("spans")),
        lambda slots: F.transform(
            "defs",
            lambda d: F.struct(d.alias("d"), definition_text(slots, d).alias("definition")),
        ),
    )
    rows = parsed.select("path", F.explode(with_text).alias("x"))
    fields = [F.col(f"x.d.{name}").alias(name) for name in DEFINITION.fieldNames()]
    return rows.select(
        "path",
        definition_id(F.col("path"), F.col("x.d")).alias("def_id"),
        F.col("x.d.kind").alias("definition_type"),
        *fields,
        F.col("x.definition").alias("definition"),
    )


def undocumented(definitions: DataFrame, skip_init: bool = True) -> DataFrame:
    """Definitions to document: no docstring yet and, by default, no ``__init__``."""
    wanted = ~F.col("has_docstring")
    if skip_init:
        wanted &= ~((F.col("kind") == FUNCTION) & (F.col("name") == "__init__"))
    return definitions.where(wanted)


def as_read(code: str | None) -> str | None:
    """A source as a text-mode read gives it, like ``normalise_code``."""
    return code and code.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


FOUND = T.StructType([*DEFINITION.fields, T.StructField("error", T.StringType())])


class ExtractDefinitions:
    """``extract_definitions(code)`` as a table function for SQL ``LATERAL`` joins.

    A module that cannot be parsed gives one row: its ``error``, and nothing else.
    """

    def eval(self, code: str) -> Iterator[tuple]:
        facts = safe_module_facts(as_read(code))
        if facts["error"] is not None:
            yield (*[None] * len(DEFINITION.fields), facts["error"])
        for item in facts["defs"] or []:
            yield (*[item[name] for name in DEFINITION.fieldNames()], None)


def register_table_function(spark) -> None:
    spark.udtf.register("extract_definitions", F.udtf(ExtractDefinitions, returnType=FOUND))
