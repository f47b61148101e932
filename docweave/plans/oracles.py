"""The same queries as ANSI SQL for DuckDB, stated independently of the package."""

from __future__ import annotations

# Corpus items by slot and what the job makes of them; #k stands for the key.
ITEMS = [
    "def f#k(a, b):\n  return a + b",
    'def f#k(a):\n  """Kept."""\n  return a',
    "def f#k(a): return a",
    "async def f#k(u):\n  await g(u)",
    "def f#k(a):\n  # note\n  return a",
    "class C#k:\n  def __init__(self, v):\n    self.v = v\n\n  def add#k(self, v):\n    self.v += v",
    'def f#k():\n  b"x"',
    'def f#k():\n  "a" "b"',
]
INIT = "def __init__(self, v):\n  self.v = v"
ADD = "def add#k(self, v):\n  self.v += v"

DOC_0 = '"""  \n  Is f#k with 2 lines.\n  \n  Args:\n    a: The a.\n    b: The b.\n  \n  Returns:\n    value: The result.\n  """'
DOC_2 = '"""  \n  Is f#k with 1 lines.\n  \n  Args:\n    a: The a.\n  \n  Returns:\n    value: The result.\n  """'
DOC_3 = '"""  \n  Is f#k with 2 lines.\n  \n  Args:\n    u: The u.\n  """'
DOC_4 = '"""  \n  Is f#k with 3 lines.\n  \n  Args:\n    a: The a.\n  \n  Returns:\n    value: The result.\n  """'
DOC_C = '"""  \n  Is C#k with 11 lines.\n  """'
DOC_ADD = '"""    \n    Is add#k with 2 lines.\n    \n    Args:\n      self: The self.\n      v: The v.\n    """'
DOC_7 = '"""  \n  Is f#k with 2 lines.\n  """'


def _rewritten(docs: dict[str, str], suites: bool, blocks: bool) -> list[str]:
    """Items with docstrings put in, for one-line bodies, for others, or for both."""

    def below(header: str, indent: str, doc: str, rest: str) -> str:
        added = f"{indent}{doc}\n{indent}\n" if blocks else ""
        return f"{header}\n{added}{rest}"

    one_line = f"def f#k(a):\n  {docs['2']}\n  \n  return a\n  " if suites else ITEMS[2]
    add = below("  def add#k(self, v):", "    ", docs["add"], "    self.v += v")
    members = f"  def __init__(self, v):\n    self.v = v\n\n{add}"
    return [
        below("def f#k(a, b):", "  ", docs["0"], "  return a + b"),
        ITEMS[1],
        one_line,
        below("async def f#k(u):", "  ", docs["3"], "  await g(u)"),
        below("def f#k(a):", "  ", docs["4"], "  # note\n  return a"),
        below("class C#k:", "  ", docs["C"], members),
        ITEMS[6],
        below("def f#k():", "  ", docs["7"], '  "a" "b"'),
    ]


FULL_DOCS = {
    "0": DOC_0, "2": DOC_2, "3": DOC_3, "4": DOC_4, "C": DOC_C, "add": DOC_ADD, "7": DOC_7,
}
PLAIN_DOCS = {key: '"""Doc of f#k."""' for key in "02347"} | {
    "C": '"""Doc of C#k."""', "add": '"""Doc of add#k."""',
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _by_slot(values: list[str]) -> str:
    cases = " ".join(f"WHEN {slot} THEN {_text(value)}" for slot, value in enumerate(values))
    return f"replace(CASE slot {cases} END, '#k', CAST(k AS VARCHAR))"


def _base(table: str = "part", key: str = "p_partkey") -> str:
    size = "p_size" if table == "part" else "0"
    return (
        f"base AS (SELECT {key} AS k, {key} % 8 AS slot, {size} AS size, 'src/m' || "
        f"lpad(CAST({key} // 8 AS VARCHAR), 12, '0') || '.py' AS path FROM {table})"
    )


def _modules(values: list[str], table: str = "part", key: str = "p_partkey") -> str:
    return (
        f"WITH {_base(table, key)}, modules AS (SELECT path, "
        f"string_agg({_by_slot(values)}, chr(10) || chr(10) ORDER BY k) || chr(10) AS code, "
        "max(CASE WHEN size = 50 THEN 1 ELSE 0 END) = 1 AS has_50 FROM base GROUP BY path)"
    )


WRITTEN = "replace(path, 'src/', 'src/modified_')"
ORIGINAL = _modules(ITEMS)
DOCUMENTED = _rewritten(FULL_DOCS, suites=True, blocks=True)

# One row per definition; j numbers the definitions of one item.
DEFS = f"""
WITH {_base()},
items AS (
  SELECT *, {_by_slot(ITEMS)} AS item,
         coalesce(sum(len(string_split({_by_slot(ITEMS)}, chr(10))) + 1) OVER (
           PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
  FROM base),
defs AS (
  SELECT path, k, slot, j,
         CASE WHEN slot = 5 AND j = 0 THEN 'C' || CAST(k AS VARCHAR)
              WHEN slot = 5 AND j = 1 THEN '__init__'
              WHEN slot = 5 THEN 'add' || CAST(k AS VARCHAR)
              ELSE 'f' || CAST(k AS VARCHAR) END AS name,
         CASE WHEN slot = 5 AND j = 0 THEN 'class' ELSE 'function' END AS kind,
         slot = 3 AS is_async,
         CAST(CASE WHEN slot = 5 AND j > 0 THEN 1 ELSE 0 END AS INTEGER) AS depth,
         CAST(above + 1 + CASE WHEN slot = 5 AND j = 1 THEN 1 WHEN slot = 5 AND j = 2 THEN 4 ELSE 0 END
              AS INTEGER) AS line,
         CAST(above + CASE WHEN slot = 5 AND j = 1 THEN 3 ELSE len(string_split(item, chr(10))) END
              AS INTEGER) AS end_line,
         slot IN (1, 6) AS has_docstring,
         slot = 2 AS single_line,
         CASE WHEN slot = 5 AND j = 1 THEN {_text(INIT)}
              WHEN slot = 5 AND j = 2 THEN replace({_text(ADD)}, '#k', CAST(k AS VARCHAR))
              ELSE item END AS definition,
         CAST(CASE WHEN slot IN (1, 6) OR (slot = 5 AND j = 1) THEN -1
                   WHEN slot = 5 AND j = 0 THEN 1 ELSE 0 END AS INTEGER) AS level
  FROM items CROSS JOIN (VALUES (0), (1), (2)) v(j)
  WHERE j = 0 OR slot = 5)
"""

# White space as Python sees it, in RE2 spelling.
WS = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LB = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def _strip_blank(text: str) -> str:
    kept = f"list_filter(string_split_regex({text}, '{LB}'), lambda x: NOT regexp_full_match(x, '{WS}*'))"
    return _strip(f"array_to_string({kept}, chr(10))")


def _capitalize(text: str) -> str:
    return f"upper(substr({_strip(text)}, 1, 1)) || substr({_strip(text)}, 2)"


def _no_prefix(text: str) -> str:
    return f"regexp_replace({text}, '^(This function|This method|This class)', '')"


def _prefixed(first: str, second: str, third: str) -> str:
    return (
        f"(CASE lang WHEN '{first}' THEN 'This function ' WHEN '{second}' THEN 'This method ' "
        f"WHEN '{third}' THEN 'This class ' ELSE '' END || text)"
    )


TOKENS = r"len(regexp_extract_all(text, '\w+|[^\w\s]'))"

REQUESTS = f"""
cleaned AS (
  SELECT doc_id, {_strip_blank('text')} AS definition,
         CASE WHEN lang = 'en' THEN 'function' ELSE 'class' END AS definition_type
  FROM documents),
rows AS (
  SELECT *, sha256('python' || chr(1) || definition || chr(1) || definition_type || chr(1) || '0.25')
            AS cache_key FROM cleaned),
requests AS (
  SELECT cache_key, any_value(definition) AS definition,
         any_value(definition_type) AS definition_type, count(*) AS uses
  FROM rows GROUP BY cache_key),
cache AS (
  SELECT cache_key, max(quality) AS quality FROM rows JOIN labels USING (doc_id) GROUP BY cache_key)
"""
FIRST_WORD = r"regexp_extract(definition, '\w+')"
DESCRIBED = (
    r"CASE WHEN regexp_matches(definition, '(?:def|class)\s+\w') "
    r"THEN regexp_extract(definition, '(?:def|class)\s+(\w+)', 1) "
    f"ELSE {FIRST_WORD} END"
)

# Rendering: every order line is a docstring with l_linenumber parameters.
LINE_ITEMS = """
WITH items AS (
  SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag,
         'Line of order ' || CAST(l_orderkey AS VARCHAR) || '.' AS description,
         'Part ' || CAST(l_partkey AS VARCHAR) || '.' AS item_text,
         range(1, l_linenumber + 1) AS numbers
  FROM lineitem)
"""


def _item_name(i: str) -> str:
    return f"CASE WHEN {i} = 3 THEN 'value' ELSE 'p' || CAST({i} AS VARCHAR) END"


def _google(ind: str = "  ") -> str:
    def line(i: str, typed: bool) -> str:
        kind = f"CASE WHEN {i} = 2 THEN '' ELSE ' (int)' END" if typed else "''"
        return f"chr(10) || '{ind}' || {_item_name(i)} || {kind} || ': ' || item_text"

    n = "l_linenumber"
    return (
        "chr(10) || description || chr(10) || chr(10) || 'Args:' || "
        f"array_to_string(list_transform(numbers, lambda i: {line('i', True)}), '') || "
        f"CASE WHEN l_linestatus = 'O' THEN chr(10) || chr(10) || 'Returns:' || {line(n, True)} ELSE '' END || "
        f"CASE WHEN l_returnflag = 'R' THEN chr(10) || chr(10) || 'Raises:' || {line(n, False)} ELSE '' END || "
        "chr(10) || chr(10)"
    )


def _numpy(ind: str = "  ") -> str:
    def line(i: str, typed: bool) -> str:
        kind = f"CASE WHEN {i} = 2 THEN '' ELSE 'int' END" if typed else "''"
        return (
            f"chr(10) || '{ind}' || {_item_name(i)} || ' : ' || {kind} || chr(10) || "
            f"'{ind}{ind}' || item_text"
        )

    def head(title: str) -> str:
        return f"chr(10) || chr(10) || '{title}' || chr(10) || '{'-' * len(title)}'"

    n = "l_linenumber"
    return (
        f"chr(10) || description || {head('Parameters')} || "
        f"array_to_string(list_transform(numbers, lambda i: {line('i', True)}), '') || "
        f"CASE WHEN l_linestatus = 'O' THEN {head('Returns')} || {line(n, True)} ELSE '' END || "
        f"CASE WHEN l_returnflag = 'R' THEN {head('Raises')} || {line(n, False)} ELSE '' END || "
        "chr(10) || chr(10)"
    )


def _raw_name(i: str) -> str:
    return f"CASE WHEN {i} = 3 THEN '' ELSE 'p' || CAST({i} AS VARCHAR) END"


def _raw_type(i: str) -> str:
    return f"CASE WHEN {i} = 2 THEN '' ELSE 'int' END"


def _google_v0() -> str:
    def line(i: str, typed: bool) -> str:
        kind = f"' (' || {_raw_type(i)} || ')'" if typed else "''"
        return f"'    ' || {_raw_name(i)} || {kind} || ': ' || item_text || chr(10)"

    n = "l_linenumber"
    return (
        "description || chr(10) || chr(10) || 'Args:' || chr(10) || "
        f"array_to_string(list_transform(numbers, lambda i: {line('i', True)}), '') || "
        f"CASE WHEN l_linestatus = 'O' THEN chr(10) || 'Returns:' || chr(10) || {line(n, True)} ELSE '' END || "
        f"CASE WHEN l_returnflag = 'R' THEN chr(10) || 'Raises:' || chr(10) || {line(n, False)} ELSE '' END"
    )


def _numpy_v0() -> str:
    def line(i: str, typed: bool) -> str:
        kind = f"' : ' || {_raw_type(i)}" if typed else "''"
        return f"{_raw_name(i)} || {kind} || chr(10) || '    ' || item_text || chr(10)"

    def head(lead: str, title: str) -> str:
        return f"{lead}'{title}' || chr(10) || '{'-' * len(title)}' || chr(10)"

    n = "l_linenumber"
    return (
        f"description || chr(10) || chr(10) || {head('', 'Parameters')} || "
        f"array_to_string(list_transform(numbers, lambda i: {line('i', True)}), '') || "
        f"CASE WHEN l_linestatus = 'O' THEN {head('chr(10) || ', 'Returns')} || {line(n, True)} ELSE '' END || "
        f"CASE WHEN l_returnflag = 'R' THEN {head('chr(10) || ', 'Raises')} || {line(n, False)} ELSE '' END"
    )


def _indented() -> str:
    pad = (
        "CASE WHEN l_linestatus = 'F' THEN repeat('  ', greatest(l_linenumber - 1, 1)) "
        "ELSE repeat(' ', l_linenumber) END"
    )
    # The text ends in two line breaks; splitting drops what follows the last one.
    text = "left(doc, length(doc) - 1)"
    return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda x: {pad} || x), chr(10))"


# Fixed value: the system text of the prompt.
SYSTEM = (
    "'You are a robot who is an expert at writing docstrings for Python classes and functions, "
    "mainly because you are extremely good at being concise.' || chr(10) || "
    "'Help the human write a docstring for the following ' || "
    "CASE WHEN lang = 'en' THEN 'function' ELSE 'class' END || ':'"
)
TRIPLE = "repeat(chr(34), 3)"
SLASHED = "replace(body, chr(92), chr(92) || chr(92))"
K_TEXT = "regexp_extract(props, '[0-9]+')"
BROKEN_DEFS = "(SELECT d.*, m.has_50 FROM defs d JOIN (SELECT path, max(CASE WHEN size = 50 THEN 1 ELSE 0 END) = 1 AS has_50 FROM base GROUP BY path) m USING (path))"

# The declarations a model is given, as JSON with sorted keys.
CLASS_SCHEMA = '{"properties": {"description": {"description": "The overall description of the class in 1 sentence; this should begin with a verb.", "type": "string"}}, "type": "object"}'
FUNCTION_SCHEMA = (
    '{"properties": {"description": {"description": "The overall description of the function in 1 sentence; this should begin with a verb.", "type": "string"}, '
    '"exceptions": {"description": "An array of descriptions for each of the exceptions the function may raise, if it has any.", "items": {"properties": {'
    '"description": {"description": "The description of the exception", "type": "string"}, "name": {"description": "The name of the exception", "type": "string"}}, "type": "object"}, "type": "array"}, '
    '"parameters": {"description": "An array of descriptions for each of the function\'s parameters, if it has any.", "items": {"properties": {'
    '"assumed_type": {"description": "The assumed type(s) of the parameter; example: \'str, int, float\'", "type": "string"}, '
    '"description": {"description": "The description of the parameter", "type": "string"}, "name": {"description": "The name of the parameter", "type": "string"}}, "type": "object"}, "type": "array"}, '
    '"return_values": {"description": "An array of descriptions for each of the function\'s return values, if it has any.", "items": {"properties": {'
    '"assumed_type": {"description": "The assumed type(s) of the return value; example: \'str, int, float\'", "type": "string"}, '
    '"description": {"description": "The description of the return value", "type": "string"}, "name": {"description": "The name of the return value", "type": "string"}}, "type": "object"}, "type": "array"}}, '
    '"type": "object"}'
)
# Modules around the texts of documents: n lines of text, then code whose lines are known.
N_LINES = "CAST(len(string_split(text, chr(10))) AS INTEGER)"


def _documented_text() -> str:
    def doc(indent: str) -> str:
        return f'{indent}"""{indent}\n{indent}Documents it.\n{indent}"""\n{indent}\n'

    quoted = "'" * 3
    code = (
        f"# #c\n@decorate\nclass D#k:\n{doc(chr(9))}\tdef outer#k(self,\n\t\t\ta):\n{doc(chr(9) * 2)}"
        f'\t\tx = """#s"""\n\t\tdef inner#k():\n{doc(chr(9) * 3)}\t\t\treturn x\n\t\treturn inner#k\n\n'
        f"def kept#k():\n\t{quoted}#s{quoted}\n"
    )
    inside = "replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(39), chr(92) || chr(39))"
    comment = "replace(text, chr(10), chr(10) || '# ')"
    return f"replace(replace(replace({_text(code)}, '#k', CAST(doc_id AS VARCHAR)), '#c', {comment}), '#s', {inside})"


# Who uses whom in the linked corpus: slot, own name, steps to the other's key (99: the next module), its name.
# In names, # is the key, + the key of the caller and one.
LINKS = (
    "(0, 'f#', 1, 'f#'), (0, 'f#', 99, 'f#'), (2, 'C#.run', 0, 'C#.stop'), (2, 'C#.stop', -1, 'f#'), (3, 'f#', 8, 'f#'), "
    "(4, 'f#', 0, 'f#.f+'), (5, 'f#', -2, 'f#'), (6, 'f#', -6, 'f#'), (6, 'f#', -4, 'C#.stop')"
)


def _linked(key: str, name: str, caller: str) -> str:
    module = f"'m' || lpad(CAST({key} // 8 AS VARCHAR), 12, '0') || '.'"
    numbered = f"replace({name}, '#', CAST({key} AS VARCHAR))"
    return f"{module} || replace({numbered}, '+', CAST({caller} + 1 AS VARCHAR))"


ORACLES: dict[str, str] = {
    "duplicate_paths": f"""
        {_modules(DOCUMENTED)}
        SELECT path, CASE WHEN CAST(substr(path, 6, 12) AS BIGINT) % 5 = 0 THEN 'read' ELSE 'ok' END AS stage,
               CASE WHEN CAST(substr(path, 6, 12) AS BIGINT) % 5 <> 0 THEN code END AS code FROM modules""",
    "write_failures": f"""
        {ORIGINAL}, named AS (SELECT CASE WHEN has_50 THEN 'skip_' ELSE '__' END || substr(path, 5) AS file, has_50 FROM modules)
        SELECT 'mapping' AS kind, file, 'ok' AS status, CAST(1 AS BIGINT) AS n FROM named WHERE NOT has_50
        UNION ALL SELECT 'error', file, 'write', 1 FROM named WHERE has_50
        UNION ALL SELECT 'summary', '', CASE WHEN has_50 THEN 'failed' ELSE 'ok' END, count(*) FROM named GROUP BY has_50""",
    "inplace_conflicts": f"""
        WITH pairs AS (
          SELECT CASE WHEN o.has_50 THEN 'skip_' ELSE '__' END || substr(o.path, 5) AS file, o.has_50,
                 CASE WHEN o.has_50 THEN o.code || '# changed' || chr(10) ELSE d.code END AS code
          FROM ({ORIGINAL} SELECT path, has_50, code FROM modules) o
          JOIN ({_modules(DOCUMENTED)} SELECT path, code FROM modules) d ON d.path = o.path)
        SELECT 'mapping' AS kind, file, 'ok' AS status, CAST(1 AS BIGINT) AS n FROM pairs WHERE NOT has_50
        UNION ALL SELECT 'error', file, 'write', 1 FROM pairs WHERE has_50
        UNION ALL SELECT 'summary', '', CASE WHEN has_50 THEN 'failed' ELSE 'ok' END, count(*) FROM pairs GROUP BY has_50
        UNION ALL SELECT 'code', file, md5(code), 1 FROM pairs""",
    "newest_events": """
        WITH versions AS (SELECT event_id, user_id, event_id % 3 AS batch, epoch_us(ts) * 1000 + event_id % 1000 AS version FROM events),
        best AS (SELECT user_id, batch, max(version) AS best FROM versions GROUP BY ALL),
        known AS (SELECT *, max(best) OVER (PARTITION BY user_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM best)
        SELECT 'u' || CAST(user_id AS VARCHAR) AS path, version,
               CASE WHEN version < known THEN 'late' WHEN version = best THEN 'newest' ELSE 'superseded' END AS status,
               CASE WHEN version = best AND version > coalesce(known, -1) THEN CAST(event_id AS VARCHAR) END AS news
        FROM versions JOIN known USING (user_id, batch)""",
    "pruned_scan": f"""
        {ORIGINAL} SELECT 'd3/' || CASE WHEN has_50 THEN 'skip_' ELSE '__' END || substr(path, 5) AS file, CAST(strlen(code) AS BIGINT) AS n_bytes
        FROM modules WHERE path LIKE '%3.py'""",
    "throttled_requests": f"""
        WITH {REQUESTS}, refused AS (SELECT *, {FIRST_WORD} AS word, left({FIRST_WORD}, 1) BETWEEN 'A' AND 'E' AS no FROM requests)
        SELECT cache_key, CASE WHEN no THEN 'rate_limited' ELSE 'ok' END AS status,
               CASE WHEN NOT no THEN 'was asked about ' || word || '.' END AS description,
               CASE WHEN no THEN 'RateLimited: come back later (given up after 3 attempts)' END AS error
        FROM refused""",
    "cached_rerun": f"{ORIGINAL} SELECT path, true AS same, CAST(0 AS BIGINT) AS calls FROM modules",
    "compacted_cache": f"{ORIGINAL} SELECT path, true AS same, CAST(0 AS BIGINT) AS calls, true AS merged FROM modules",
    "function_declarations": f"""
        SELECT doc_id, CASE WHEN lang = 'en' THEN 'respond_with_structured_docstring_data_for_function'
                            ELSE 'respond_with_structured_docstring_data_for_class' END AS name,
               CASE WHEN lang = 'en' THEN {_text(FUNCTION_SCHEMA)} ELSE {_text(CLASS_SCHEMA)} END AS parameters
        FROM documents""",
    "routed_requests": f"""
        WITH {REQUESTS}, sized AS (SELECT cache_key, {TOKENS.replace("text", "definition")} AS tokens FROM requests)
        SELECT cache_key, CASE WHEN tokens <= 800 THEN 'ok' ELSE 'too_many_tokens' END AS status,
               CASE WHEN tokens <= 200 THEN 'was made by small.' WHEN tokens <= 800 THEN 'was made by large.' END AS description
        FROM sized""",
    "extract_definitions_sql": f"""
        {DEFS}
        SELECT path, name, kind, line, false AS broken FROM {BROKEN_DEFS} b WHERE NOT has_50
        UNION ALL SELECT path, NULL, NULL, NULL, true FROM (SELECT DISTINCT path FROM {BROKEN_DEFS} b WHERE has_50) x""",
    "extract_definitions_table": f"""
        {DEFS}
        SELECT path, name, kind, line, false AS broken FROM {BROKEN_DEFS} b WHERE NOT has_50
        UNION ALL SELECT path, NULL, NULL, NULL, true FROM (SELECT DISTINCT path FROM {BROKEN_DEFS} b WHERE has_50) x""",
    "generate_sql": f"""
        WITH {REQUESTS}
        SELECT doc_id, 'ok' AS status, 'This ' || definition_type || ' is ' || {DESCRIBED} || ' with ' ||
               CAST(len(string_split(definition, chr(10))) AS VARCHAR) || ' lines.' AS description
        FROM rows""",
    "referenced_definitions": f"""
        WITH RECURSIVE items AS (SELECT doc_id AS k, doc_id % 8 AS slot FROM documents),
        links(slot, own, step, other) AS (VALUES {LINKS}),
        edges AS (
          SELECT DISTINCT {_linked('a.k', 'own', 'a.k')} AS caller, {_linked('b.k', 'other', 'a.k')} AS callee
          FROM items a JOIN links USING (slot)
          JOIN items b ON b.k = CASE WHEN step = 99 THEN (a.k // 8 + 1) * 8 ELSE a.k + step END),
        walk AS (
          SELECT caller, callee, 1 AS hops FROM edges
          UNION SELECT w.caller, e.callee, hops + 1 FROM walk w JOIN edges e ON w.callee = e.caller WHERE hops < 3)
        SELECT caller AS caller_name, callee AS callee_name, CAST(min(hops) AS INTEGER) AS hops
        FROM walk WHERE caller <> callee GROUP BY ALL""",
    "extract_definitions_text": f"""
        SELECT 'src/d' || CAST(doc_id AS VARCHAR) || '.py' AS path, v.name || CAST(doc_id AS VARCHAR) AS name, v.kind, v.depth, v.level,
               CASE v.name WHEN 'D' THEN n + 2 WHEN 'outer' THEN n + 3 WHEN 'inner' THEN 2 * n + 5 ELSE 2 * n + 9 END AS line,
               CASE v.name WHEN 'D' THEN 2 * n + 7 WHEN 'outer' THEN 2 * n + 7 WHEN 'inner' THEN 2 * n + 6 ELSE 3 * n + 9 END AS end_line,
               v.name = 'kept' AS has_docstring
        FROM (SELECT doc_id, {N_LINES} AS n FROM documents) d
        CROSS JOIN (VALUES ('D', 'class', 0::INTEGER, 2::INTEGER), ('outer', 'function', 1, 1), ('inner', 'function', 2, 0),
                           ('kept', 'function', 0, -1)) v(name, kind, depth, level)""",
    "rewrite_sources_text": f"SELECT 'src/d' || CAST(doc_id AS VARCHAR) || '.py' AS path, {_documented_text()} AS code FROM documents",
    "file_set_difference": f"WITH {_base()} SELECT path FROM base EXCEPT SELECT path FROM base WHERE size = 50",
    "source_stats": f"{ORIGINAL} SELECT path, CAST(len(string_split(code, chr(10))) AS BIGINT) AS n_lines, CAST(length(code) AS BIGINT) AS n_chars FROM modules",
    "scan_sources": f"{ORIGINAL} SELECT '__' || substr(path, 5) AS file, CAST(length(code) AS BIGINT) AS n_chars, md5(code) AS digest FROM modules WHERE NOT has_50",
    "extract_definitions": f"{DEFS} SELECT path, name, kind, is_async, depth, line, end_line, has_docstring, single_line, definition FROM defs",
    "has_docstring": f"{DEFS} SELECT path, name, has_docstring FROM defs",
    "undocumented": f"{DEFS} SELECT path, name FROM defs WHERE NOT has_docstring",
    "undocumented_skip_init": f"{DEFS} SELECT path, name FROM defs WHERE NOT has_docstring AND name <> '__init__'",
    "definitions_by_type": f"{DEFS} SELECT kind AS definition_type, count(*) AS n FROM defs GROUP BY kind",
    "single_line_defs": f"{DEFS} SELECT path, name, line FROM defs WHERE single_line",
    "definition_depths": f"{DEFS} SELECT path, name, depth, level FROM defs",
    "validate_types": """
        SELECT doc_id, definition_type,
               CASE definition_type
                 WHEN 'function' THEN 'respond_with_structured_docstring_data_for_function'
                 WHEN 'class' THEN 'respond_with_structured_docstring_data_for_class' END AS call_name,
               CASE WHEN definition_type IN ('function', 'class') THEN 'ok'
                    ELSE 'unsupported_definition_type' END AS type_status
        FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'function' WHEN 'fr' THEN 'class' ELSE lang END
              AS definition_type FROM documents) d""",
    "language_lookup": """
        SELECT conv_id, turn, CASE role WHEN 'user' THEN 'python' ELSE role END AS language,
               CASE role WHEN 'user' THEN 'Python' END AS stylized_name,
               CASE role WHEN 'user' THEN 'ok' ELSE 'unknown_language' END AS language_status
        FROM conversations""",
    "strip_blank_lines": f"""
        SELECT doc_id, {_strip_blank("(chr(10) || ' ' || chr(9) || chr(10) || '  ' || replace(text, chr(10), chr(10) || ' ' || chr(10) || chr(10)) || chr(10) || chr(10))")} AS definition
        FROM documents""",
    "remove_prefix": f"SELECT doc_id, {_no_prefix(_prefixed('en', 'fr', 'es'))} AS description FROM documents",
    "capitalize_first": f"SELECT conv_id, turn, {_capitalize('lower(text)')} AS description FROM conversations",
    "reject_empty": f"""
        SELECT conv_id, turn,
               CASE WHEN {_strip(_no_prefix("CASE WHEN role = 'user' THEN 'This method ' || chr(10) || ' ' ELSE text END"))} = ''
                    THEN 'empty_description' ELSE 'ok' END AS status
        FROM conversations""",
    "postprocess_docstring": f"SELECT doc_id, {_capitalize(_no_prefix(_prefixed('de', 'en', 'es')))} AS description, lang AS parameter FROM documents",
    "output_path": f"WITH {_base()} SELECT DISTINCT path, {WRITTEN} AS written_path, path AS inplace_path FROM base",
    "token_count_estimate": f"SELECT doc_id, CAST({TOKENS} AS BIGINT) AS tokens FROM documents",
    "build_messages": f"""
        SELECT doc_id, CAST(2 AS INTEGER) AS n_messages, 'system' AS first_role, {SYSTEM} AS system_text,
               'user' AS second_role, text AS user_text FROM documents""",
    "generate_docstrings": f"""
        WITH {REQUESTS}
        SELECT cache_key, 'ok' AS status, 'This ' || definition_type || ' is ' || {DESCRIBED} || ' with ' ||
               CAST(len(string_split(definition, chr(10))) AS VARCHAR) || ' lines.' AS description
        FROM requests""",
    "cache_misses": f"WITH {REQUESTS} SELECT cache_key, definition_type, uses FROM requests WHERE cache_key NOT IN (SELECT cache_key FROM cache)",
    "cache_hit_join": f"WITH {REQUESTS} SELECT doc_id, rows.cache_key, quality, quality IS NOT NULL AS hit FROM rows LEFT JOIN cache USING (cache_key)",
    "reply_status": """
        SELECT event_id, status, CASE WHEN status = 'ok' THEN props END AS arguments
        FROM (SELECT event_id, props,
                CASE event_type WHEN 'error' THEN 'no_function_call' WHEN 'signup' THEN 'skipped'
                  WHEN 'click' THEN 'unexpected_function'
                  WHEN 'purchase' THEN CASE WHEN value >= 10 THEN 'no_function_call' ELSE 'invalid_arguments' END
                  ELSE 'ok' END AS status
              FROM events) e""",
    "parse_arguments": f"""
        SELECT event_id, event_type = 'view' AS valid,
               CASE WHEN event_type = 'view' THEN
                 CASE WHEN value >= 10 THEN 'Counts ' || {K_TEXT} || '.' ELSE '' END END AS description,
               CAST(CASE WHEN event_type = 'view' THEN CASE WHEN value >= 10 THEN 2 ELSE 0 END END AS INTEGER) AS n_parameters,
               CASE WHEN event_type = 'view' AND value >= 10 THEN 'k' END AS first_name,
               CASE WHEN event_type = 'view' AND value >= 10 THEN '' END AS second_name,
               CASE WHEN event_type = 'view' AND value >= 10 THEN 'int' END AS second_type
        FROM events""",
    "over_budget": f"SELECT doc_id, CAST({TOKENS} AS BIGINT) AS tokens, CASE WHEN {TOKENS} > 4096 THEN 'too_many_tokens' ELSE 'ok' END AS status FROM documents",
    "route_model": f"SELECT doc_id, CASE WHEN {TOKENS} <= 4096 THEN 'gpt-3.5-turbo-0613' WHEN {TOKENS} <= 16384 THEN 'gpt-3.5-turbo-16k-0613' END AS model FROM documents",
    "generation_errors": f"""
        WITH {REQUESTS}
        SELECT cache_key,
               CASE WHEN length(definition) > 4096 THEN 'too_many_tokens' ELSE 'generation_error' END AS status,
               CASE WHEN length(definition) > 4096
                    THEN 'TooManyTokens: ' || CAST(length(definition) AS VARCHAR) || ' characters'
                    ELSE 'ValueError: cannot describe ' || {FIRST_WORD} END AS error
        FROM requests
        WHERE length(definition) > 4096 OR left({FIRST_WORD}, 1) IN ('A', 'E')""",
    "render_google": f"{LINE_ITEMS} SELECT l_orderkey, l_linenumber, {_google()} AS docstring FROM items",
    "render_numpy": f"{LINE_ITEMS} SELECT l_orderkey, l_linenumber, {_numpy()} AS docstring FROM items",
    "render_prototype": f"{LINE_ITEMS} SELECT l_orderkey, l_linenumber, {_google_v0()} AS google, {_numpy_v0()} AS numpy FROM items",
    "indent_docstring": f"{LINE_ITEMS}, docs AS (SELECT *, {_google()} AS doc FROM items) SELECT l_orderkey, l_linenumber, {_indented()} AS docstring FROM docs",
    "quote_docstring": f"""
        SELECT doc_id,
               {TRIPLE} || replace({SLASHED}, {TRIPLE}, repeat(chr(92) || chr(34), 3)) || {TRIPLE} AS triple,
               chr(39) || replace(replace({SLASHED}, chr(39), chr(92) || chr(39)), chr(10), chr(92) || 'n')
               || chr(39) AS single
        FROM (SELECT doc_id, chr(92) || 'd ' || chr(34) || text || {TRIPLE} AS body FROM documents) d""",
    "splice_multiline": f"{_modules(_rewritten(PLAIN_DOCS, suites=False, blocks=True))} SELECT path, code FROM modules",
    "splice_one_line": f"{_modules(_rewritten(PLAIN_DOCS, suites=True, blocks=False))} SELECT path, code FROM modules",
    "rendered_docstrings": f"""
        {DEFS}
        SELECT path, name, replace(CASE WHEN slot = 5 AND j = 0 THEN {_text(DOC_C)} WHEN slot = 5 THEN {_text(DOC_ADD)}
               WHEN slot = 0 THEN {_text(DOC_0)} WHEN slot = 2 THEN {_text(DOC_2)} WHEN slot = 3 THEN {_text(DOC_3)}
               WHEN slot = 4 THEN {_text(DOC_4)} ELSE {_text(DOC_7)} END, '#k', CAST(k AS VARCHAR)) AS docstring
        FROM defs WHERE level >= 0""",
    "rewrite_sources": f"{_modules(DOCUMENTED)} SELECT path, {WRITTEN} AS written_path, code FROM modules",
    "rewrite_sources_orders": f"{_modules(DOCUMENTED, 'orders', 'o_orderkey')} SELECT path, {WRITTEN} AS written_path, code FROM modules",
    "document_published": f"{_modules(DOCUMENTED)} SELECT 'modified___' || substr(path, 5) AS file, code FROM modules WHERE NOT has_50",
    "failed_files": f"{ORIGINAL} SELECT path, 'parse' AS stage FROM modules WHERE has_50",
    "run_summary": f"""
        {DEFS}
        SELECT 'file' AS stage, CASE WHEN has_50 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n
        FROM (SELECT DISTINCT path, has_50 FROM {BROKEN_DEFS} b) f GROUP BY has_50
        UNION ALL
        SELECT 'definition', 'ok', count(*) FROM {BROKEN_DEFS} b WHERE NOT has_50 AND level >= 0""",
    "result_mapping": f"{ORIGINAL} SELECT path, {WRITTEN} AS written_path FROM modules WHERE NOT has_50",
    "empty_outputs": f"{ORIGINAL} SELECT path, {WRITTEN} AS written_path, 'missing' AS reason FROM modules WHERE has_50",
}
