"""A code corpus derived from a keyed table: eight module items per path, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Item text by slot (key % 8); #k stands for the key. The same texts, in SQL, are in oracles.py.
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


def corpus(spark: SparkSession, sf_dir: str, table: str = "part", key: str = "p_partkey") -> DataFrame:
    """``(path, code)``: every row of the table becomes an item of a module."""
    keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("k"))
    template = F.element_at(F.array(*map(F.lit, ITEMS)), (F.col("k") % 8 + 1).cast("int"))
    number = F.floor(F.col("k") / 8).cast("bigint").cast("string")
    items = keys.select(
        "k",
        F.concat(F.lit("src/m"), F.lpad(number, 12, "0"), F.lit(".py")).alias("path"),
        F.replace(template, F.lit("#k"), F.col("k").cast("string")).alias("text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("k", "text")))
    code = F.concat(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n"), F.lit("\n"))
    # Parsing is heavy for its bytes: keep all partitions instead of merging small ones.
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return items.repartition(slices, "path").groupBy("path").agg(code.alias("code"))


# A module around a document's text; #c stands for it as a comment, #s as the inside of a string.
TEXT_MODULE = (
    "# #c\n@decorate\nclass D#k:\n\tdef outer#k(self,\n\t\t\ta):\n\t\tx = \"\"\"#s\"\"\"\n"
    "\t\tdef inner#k():\n\t\t\treturn x\n\t\treturn inner#k\n\ndef kept#k():\n\t'''#s'''\n"
)


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, code)``: every document's text stands in the comments and strings of a module.

    Nested definitions, tabs, a decorator, a header of two lines, strings of many lines; odd
    modules have CRLF line ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.col("text")
    inside = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for quote in ('"', "'"):
        inside = F.replace(inside, F.lit(quote), F.lit("\\" + quote))
    key = F.col("doc_id").cast("string")
    code = F.lit(TEXT_MODULE)
    for mark, value in (("#k", key), ("#c", F.replace(text, F.lit("\n"), F.lit("\n# "))), ("#s", inside)):
        code = F.replace(code, F.lit(mark), value)
    ended = F.when(F.col("doc_id") % 2 == 1, F.replace(code, F.lit("\n"), F.lit("\r\n"))).otherwise(code)
    return docs.select(F.concat(F.lit("src/d"), key, F.lit(".py")).alias("path"), ended.alias("code"))


# Items that refer to each other by slot (key % 8). #k stands for the key, #{+n} for the key and n; e is
# the first item of the next module, which every module imports.
LINKED_ITEMS = [
    "def f#k(a):\n  return f#{+1}(a) + e(a)",
    "def f#k(a, f#{-1}):\n  return f#{-1}(a)",
    "class C#k:\n  def run(self, x):\n    return self.stop(x)\n\n  def stop(self, x):\n    return f#{-1}(x)",
    "def f#k(a):\n  return nxt.f#{+8}(a)",
    "def f#k(a):\n  def f#{+1}(b):\n    return b\n  return f#{+1}(a)",
    "def f#k(a):\n  return [f#{-2}(x) for x in a]",
    "@f#{-6}\ndef f#k(a=C#{-4}.stop):\n  return a",
    "def f#k(a):\n  return len(a)",
]


def linked_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, code)``: modules of eight items that use each other and the next module, by doc_id."""
    k = F.col("doc_id")
    text = F.element_at(F.array(*map(F.lit, LINKED_ITEMS)), (k % 8 + 1).cast("int"))
    for step in (1, 8, -1, -2, -4, -6):
        text = F.replace(text, F.lit(f"#{{{step:+d}}}"), (k + step).cast("string"))
    number = F.floor(k / 8).cast("bigint")
    items = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        number.alias("number"), F.struct("doc_id", F.replace(text, F.lit("#k"), k.cast("string")).alias("text")).alias("item")
    )
    following = F.concat(F.lit("m"), F.lpad((F.col("number") + 1).cast("string"), 12, "0"))
    head = F.concat(
        F.lit("import "), following, F.lit(" as nxt\nfrom "), following,
        F.lit(" import f"), ((F.col("number") + 1) * 8).cast("string"), F.lit(" as e\n\n"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["text"]), "\n\n")
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    modules = items.repartition(slices, "number").groupBy("number").agg(body.alias("body"))
    return modules.select(
        F.concat(F.lit("src/m"), F.lpad(F.col("number").cast("string"), 12, "0"), F.lit(".py")).alias("path"),
        F.concat(head, "body", F.lit("\n")).alias("code"),
    )
