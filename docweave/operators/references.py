"""Which definitions a definition refers to, across modules, and their texts as context.

One pass of Python per module resolves names by scope: a name bound in a function hides those
outside it, a class body is not seen from its methods, `self` and `cls` (a method's first
parameter) stand for the class, imports give the absolute name they stand for. It returns names
only. All the rest are joins of names: absolute names with the definitions of all modules (the longest
part of a dotted name that is one; names that a module imports stand for what they import), then
the references of references, up to a number of hops.

Not followed: assignments, base classes, calls whose object is only known when they run. Of
definitions with one name the last in the file counts, as it does when the module is read. Modules
that cannot be parsed have no references and define nothing. Two files with one module name (none
or several roots) are taken as one module.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import token_count as estimated_tokens
from ..workspace import new_run_folder
from .extract import as_read, definition_id
from .requests import hot_keys, join_by_key

NAMES = (
    "symbols ARRAY<STRUCT<name: STRING, line: INT, col: INT>>, "
    "aliases ARRAY<STRUCT<name: STRING, target: STRING>>, "
    "uses ARRAY<STRUCT<line: INT, col: INT, target: STRING>>"
)
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
#: A re-export of a re-export is followed this often.
ALIAS_STEPS = 3


@dataclass(slots=True)
class _Scope:
    outer: _Scope | None
    owner: tuple[int, int] | None  # line and character of the definition that a use belongs to
    name: str  # absolute name of the definition or module
    is_class: bool = False
    #: What a name stands for; None for what only the running program knows.
    bound: dict[str, str | None] = field(default_factory=dict)
    stars: list[str] = field(default_factory=list)
    elsewhere: set[str] = field(default_factory=set)  # declared global or nonlocal
    waiting: list[tuple[ast.AST, _Scope]] = field(default_factory=list)

    def bind(self, name: str, target: str | None) -> None:
        if name not in self.elsewhere and (target is not None or name not in self.bound):
            self.bound[name] = target


class _Names:
    def __init__(self, code: str, module: str, package: bool):
        self.lines = code.split("\n")
        self.module, self.package = module, package
        self.symbols: list[dict] = []
        self.uses: set[tuple[int, int, str]] = set()
        top = _Scope(None, None, module)
        self.fill(top, ast.parse(code).body)
        self.aliases = {
            **{star: None for star in top.stars},
            **{name: target for name, target in top.bound.items() if target and target != f"{module}.{name}"},
        }
        # Depth first without recursion: a scope is complete before the ones inside it are read.
        scopes = [top]
        while scopes:
            scope = scopes.pop()
            for node, inside in scope.waiting:
                if isinstance(node, (ast.Name, ast.Attribute)):
                    self.use(node, inside)
                elif node is not None:
                    self.enter(node, scope, inside)
                    scopes.append(inside)

    def column(self, node: ast.stmt) -> int:
        line = self.lines[node.lineno - 1]
        return node.col_offset if line.isascii() else len(line.encode()[: node.col_offset].decode())

    def fill(self, scope: _Scope, nodes: Iterable[ast.AST], owner: _Scope | None = None) -> None:
        """Bind what the nodes bind in a scope, and note its uses and inner scopes for later."""
        owner = owner or scope
        stack = list(nodes)[::-1]
        while stack:
            node = stack.pop()
            if isinstance(node, _DEFINITIONS):
                name = f"{scope.name}.{node.name}"
                inside = _Scope(scope, (node.lineno, self.column(node)), name, isinstance(node, ast.ClassDef))
                scope.bind(node.name, name)
                self.symbols.append({"name": name, "line": node.lineno, "col": inside.owner[1]})
                scope.waiting.append((node, inside))
                # Decorators, defaults, bases and annotations are read outside, but are the definition's.
                around = _Scope(scope, inside.owner, scope.name)
                around.bound = scope.bound
                self.fill(scope, _header(node), around)
            elif isinstance(node, (ast.Lambda, *_COMPREHENSIONS)):
                scope.waiting.append((node, _Scope(scope, owner.owner, scope.name)))
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                self.imported(scope, node)
            elif isinstance(node, (ast.Global, ast.Nonlocal)):
                scope.elsewhere.update(node.names)
                for name in node.names:
                    scope.bound.pop(name, None)
            elif isinstance(node, ast.Name):
                if isinstance(node.ctx, ast.Load):
                    scope.waiting.append((node, owner))
                else:
                    scope.bind(node.id, None)
            elif isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Load) and _dotted(node):
                scope.waiting.append((node, owner))
            else:
                for name in _named(node):
                    scope.bind(name, None)
                stack.extend(list(ast.iter_child_nodes(node))[::-1])

    def enter(self, node: ast.AST, outer: _Scope, inside: _Scope) -> None:
        if isinstance(node, _COMPREHENSIONS):
            self.fill(inside, ast.iter_child_nodes(node))
            return
        if not isinstance(node, ast.ClassDef):
            given = node.args
            parameters = [*given.posonlyargs, *given.args, given.vararg, *given.kwonlyargs, given.kwarg]
            for parameter in filter(None, parameters):
                inside.bind(parameter.arg, None)
            first = [*given.posonlyargs, *given.args][:1]
            static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in getattr(node, "decorator_list", ()))
            if outer.is_class and first and not static:
                inside.bound[first[0].arg] = outer.name
        self.fill(inside, node.body if isinstance(node.body, list) else [node.body])

    def imported(self, scope: _Scope, node: ast.Import | ast.ImportFrom) -> None:
        if isinstance(node, ast.Import):
            for item in node.names:
                first = item.name.partition(".")[0]
                scope.bind(item.asname or first, item.name if item.asname else first)
            return
        source = node.module or ""
        if node.level:
            parts = self.module.split(".")
            kept = parts[: len(parts) - node.level + self.package]
            source = ".".join([*kept, *filter(None, [source])])
        for item in node.names:
            if item.name == "*":
                scope.stars.append(source)
            else:
                scope.bind(item.asname or item.name, f"{source}.{item.name}")

    def use(self, node: ast.Name | ast.Attribute, scope: _Scope) -> None:
        root, *rest = _dotted(node)
        at: _Scope | None = scope
        stars: list[str] = []
        while at is not None:
            if root in at.bound and (at is scope or not at.is_class):
                target = at.bound[root]
                found = [] if target is None else [target]
                break
            stars += at.stars
            at = at.outer
        else:
            found = [f"{star}.{root}" for star in stars]
        for target in found:
            if scope.owner is not None:
                self.uses.add((*scope.owner, ".".join([target, *rest])))


def _header(node: ast.AST) -> list[ast.AST]:
    parts = [*node.decorator_list]
    if isinstance(node, ast.ClassDef):
        return parts + [*node.bases, *(keyword.value for keyword in node.keywords)]
    given = node.args
    parameters = [*given.posonlyargs, *given.args, given.vararg, *given.kwonlyargs, given.kwarg]
    notes = [parameter.annotation for parameter in parameters if parameter]
    return [part for part in [*parts, *given.defaults, *given.kw_defaults, *notes, node.returns] if part]


def _named(node: ast.AST) -> Iterator[str]:
    """Names that a node binds other than by a `Name`."""
    if isinstance(node, ast.ExceptHandler) or isinstance(node, (ast.MatchAs, ast.MatchStar)):
        if node.name:
            yield node.name
    elif isinstance(node, ast.MatchMapping) and node.rest:
        yield node.rest


def _dotted(node: ast.AST) -> list[str]:
    """The names of `a.b.c`; none if it begins with anything but a name."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return [node.id, *reversed(names)] if isinstance(node, ast.Name) else []


def module_names(code: str | None, module: str, package: bool) -> dict:
    """Symbols, aliases and uses of a module; none if it cannot be parsed."""
    try:
        names = _Names(as_read(code) or "", module, package)
    except Exception:  # one bad file must never fail the others
        return {"symbols": [], "aliases": [], "uses": []}
    return {
        "symbols": names.symbols,
        "aliases": [
            {"name": f"{module}.{name}" if target else module, "target": target or name}
            for name, target in names.aliases.items()
        ],
        "uses": [{"line": a, "col": b, "target": c} for a, b, c in sorted(names.uses)],
    }


def module_name(path: Column, roots: Iterable[str] = ()) -> Column:
    """The dotted name of a module: its path below the longest of the roots it lies in."""
    below = F.regexp_replace(path, r"\.py$", "")
    for root in sorted(roots, key=len):
        folder = root.rstrip("/") + "/"
        inside = F.regexp_replace(F.substring(path, len(folder) + 1, 2**30), r"\.py$", "")
        below = F.when(path.startswith(folder), inside).otherwise(below)
    return F.replace(F.regexp_replace(F.ltrim(below, F.lit("/")), "/__init__$", ""), F.lit("/"), F.lit("."))


@dataclass(frozen=True)
class References:
    """Stored tables: ``symbols`` (def_id, symbol) and ``edges`` (caller, callee: ids of definitions)."""

    symbols: DataFrame
    edges: DataFrame
    folder: str


def _stored(rows: DataFrame, folder: str) -> DataFrame:
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _slices(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def references(files: DataFrame, roots: Iterable[str] = ()) -> References:
    """Who refers to whom in ``(path, code)``, all modules together.

    Code is read once and never shuffled. Names are resolved once for all their uses; a name that
    many definitions use is salted when the answer is joined back.
    """
    spark = files.sparkSession
    _, folder = new_run_folder(spark)
    made = T.StructType.fromDDL(NAMES)
    arrow_type = to_arrow_type(made)

    def names_of(code: pa.Array, module: pa.Array, package: pa.Array) -> pa.Array:
        rows = zip(code.to_pylist(), module.to_pylist(), package.to_pylist())
        return pa.array([module_names(*row) for row in rows], type=arrow_type)

    read = F.arrow_udf(names_of, made).asNondeterministic()
    is_package = F.col("path").endswith("/__init__.py")
    named = files.select("path", read("code", module_name(F.col("path"), roots), is_package).alias("n"))
    facts = _stored(named.select("path", "n.*"), f"{folder}/names")
    found = facts.select("path", F.explode("symbols").alias("s"))
    def_id = definition_id(F.col("path"), F.col("s")).alias("def_id")
    symbols = _stored(found.select(F.col("s.name").alias("symbol"), def_id, "s.line"), f"{folder}/symbols")
    last = symbols.groupBy("symbol").agg(F.max_by("def_id", F.struct("line", "def_id")).alias("def_id"))
    aliases = facts.select(F.explode("aliases").alias("a")).select("a.name", "a.target")
    used = facts.select("path", F.explode("uses").alias("u"))
    caller = definition_id(F.col("path"), F.col("u")).alias("caller")
    uses = _stored(used.select(caller, F.col("u.target").alias("cache_key")), f"{folder}/uses")
    counted = _stored(uses.groupBy("cache_key").agg(F.count("*").alias("uses")), f"{folder}/targets")
    answers = _resolved(counted.select(F.col("cache_key").alias("target")), last, aliases, folder)
    hot = hot_keys(counted, uses.count(), _slices(spark))
    joined = join_by_key(uses, answers, hot, F.col("caller"))
    edges = joined.where("callee IS NOT NULL AND callee <> caller").select("caller", "callee").distinct()
    return References(symbols.select("def_id", "symbol"), _stored(edges, f"{folder}/edges"), folder)


def _resolved(targets: DataFrame, symbols: DataFrame, aliases: DataFrame, folder: str) -> DataFrame:
    """``(cache_key, callee)`` of the dotted names of which some part is a definition.

    A name counts once for each definition it may stand for; of several (from imports of all
    names of two modules) the first in order is kept.
    """
    none = F.lit(None).cast("string")
    defined = symbols.select(F.col("symbol").alias("prefix"), "def_id", none.alias("to"))
    imported = aliases.select(F.col("name").alias("prefix"), none.alias("def_id"), F.col("target").alias("to"))
    known = _stored(defined.unionByName(imported), f"{folder}/known")
    waiting = targets.select(F.col("target").alias("cache_key"), "target")
    done: DataFrame | None = None
    for step in range(ALIAS_STEPS + 1):
        parts = F.split("target", r"\.")
        sizes = F.sequence(F.lit(1), F.size(parts))
        of_size = F.transform(sizes, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
        prefixes = waiting.select("cache_key", "target", F.explode(of_size).alias("prefix"))
        # The longest part wins; a definition before an alias of the same name.
        rank = F.struct(F.length("prefix"), F.col("def_id").isNotNull())
        top = F.max(rank).over(Window.partitionBy("cache_key", "target"))
        met = prefixes.join(known, "prefix").withColumns({"rank": rank, "top": top}).where("rank = top").drop("rank", "top")
        met = _stored(met, f"{folder}/met-{step}")
        answers = met.where("def_id IS NOT NULL").select("cache_key", F.col("def_id").alias("callee"))
        done = answers if done is None else done.unionByName(answers)
        rest = F.substr("target", F.length("prefix") + 1)
        waiting = met.where("def_id IS NULL").select("cache_key", F.concat("to", rest).alias("target")).distinct()
    return done.groupBy("cache_key").agg(F.min("callee").alias("callee"))


def reachable(found: References, hops: int = 2) -> DataFrame:
    """``(caller, callee, hops)`` up to a number of hops, each pair once with the fewest.

    A step joins the newest pairs with the references of their ends, kept as one row per definition;
    an end that many definitions reach is salted.
    """
    edges, spark = found.edges, found.edges.sparkSession
    _, folder = new_run_folder(spark)
    by_caller = edges.groupBy(F.col("caller").alias("cache_key"))
    onward = _stored(by_caller.agg(F.collect_list("callee").alias("next")), f"{folder}/onward")
    newest = reached = edges.withColumn("hops", F.lit(1))
    for step in range(2, hops + 1):
        ends = newest.groupBy(F.col("callee").alias("cache_key")).agg(F.count("*").alias("uses"))
        hot = hot_keys(ends, newest.count(), _slices(spark))
        rows = newest.select("caller", F.col("callee").alias("cache_key"))
        met = join_by_key(rows, onward, hot, F.col("caller")).select("caller", F.explode("next").alias("callee"))
        new = met.where("caller <> callee").distinct().join(reached.select("caller", "callee"), ["caller", "callee"], "left_anti")
        newest = _stored(new.withColumn("hops", F.lit(step)), f"{folder}/hop-{step}")
        reached = reached.unionByName(newest)
    return reached


def reference_context(definitions: DataFrame, reached: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """``(caller, context, n_references)``: the texts a definition refers to, nearest first, within a budget.

    ``definitions`` has ``def_id`` and ``definition``. Lengths are joined first; texts are fetched
    only for what the budget keeps, so what a definition gets is bounded whatever it reaches. Its
    reach as rows of ids must fit one task. The first text that no longer fits ends the context.
    """
    _, folder = new_run_folder(definitions.sparkSession)
    texts = definitions.select(F.col("def_id").alias("callee"), "definition")
    sized = _stored(texts.withColumn("tokens", estimated_tokens(F.col("definition"))), f"{folder}/sized")
    order = Window.partitionBy("caller").orderBy("hops", "callee").rowsBetween(Window.unboundedPreceding, 0)
    kept = (
        reached.join(sized.select("callee", "tokens"), "callee")
        .withColumn("so_far", F.sum("tokens").over(order))
        .where(F.col("so_far") <= max_tokens)
        .select("caller", "callee", "hops")
    )
    joined = kept.join(sized.select("callee", "definition"), "callee")
    ordered = F.array_sort(F.collect_list(F.struct("hops", "callee", "definition")))
    return joined.groupBy("caller").agg(
        F.array_join(F.transform(ordered, lambda x: x["definition"]), "\n\n").alias("context"),
        F.count("*").alias("n_references"),
    )
