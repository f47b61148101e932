"""Text columns against Python's own string methods."""

import ast
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions.render import quote_docstring
from docweave.functions.text import (
    capitalize_first,
    indent_lines,
    normalise_code,
    output_path,
    remove_stock_prefix,
    strip,
    strip_blank_lines,
    tidy_description,
    token_count,
)

# Every kind of white space and line break, plus some that only look like it.
CHARS = "ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2003\u2028\u2029\u202f\u3000\u200b\ufeffß\"'\\"
TEXTS = st.lists(st.text(CHARS, max_size=14), min_size=200, max_size=200)


def evaluate(spark, texts, build):
    rows = spark.createDataFrame(list(enumerate(texts)), "n INT, t STRING")
    return [r[0] for r in rows.orderBy("n").select(build(F.col("t"))).collect()]


def python_clean(text):
    return "\n".join(line for line in text.splitlines() if line.strip()).strip()


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_cleaning_equals_python(spark, texts):
    assert evaluate(spark, texts, strip) == [t.strip() for t in texts]
    assert evaluate(spark, texts, strip_blank_lines) == [python_clean(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_indenting_equals_python(spark, texts):
    texts = [t for t in texts if t]
    got = evaluate(spark, texts, lambda t: indent_lines(t, F.lit("  ")))
    assert got == ["\n".join("  " + line for line in t.splitlines()) for t in texts]


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_quoted_text_reads_back(spark, texts):
    # Python's own reader turns \r into \n inside literals; the job never sees \r in code.
    texts = ["\n" + t.replace("\r", "") + "\n  " for t in texts]
    for quote in ('"""', "'''", '"', "'"):
        quoted = evaluate(spark, texts, lambda t, quote=quote: quote_docstring(t, quote))
        assert [ast.literal_eval(q) for q in quoted] == texts


def test_every_character_as_padding_and_separator(spark):
    chars = [chr(n) for n in range(1, 0x10000) if not 0xD800 <= n < 0xE000]
    padded = [f"{c}a{c}" for c in chars]
    assert evaluate(spark, padded, strip) == [t.strip() for t in padded]
    parted = [f"a{c}{c}  b" for c in chars]
    assert evaluate(spark, parted, strip_blank_lines) == [python_clean(t) for t in parted]


def test_descriptions(spark):
    texts = ["This functionality x", " This method y", "This class  z ", "ßig", "ǆ", "This function "]
    assert evaluate(spark, texts, tidy_description) == [
        "Ality x", "This method y", "Z", "SSig", "Ǆ", "",
    ]
    assert evaluate(spark, ["this class x"], remove_stock_prefix) == ["this class x"]
    assert evaluate(spark, ["  éa B"], capitalize_first) == ["Éa B"]


def test_paths_and_tokens(spark):
    paths = ["a.py", "x/a.py", "/x/y/__init__.py", "./b.py"]
    assert evaluate(spark, paths, output_path) == [
        "modified_a.py", "x/modified_a.py", "/x/y/modified___init__.py", "./modified_b.py",
    ]
    assert evaluate(spark, paths, lambda p: output_path(p, inplace=True)) == paths
    texts = ["Hello test 1 2 3 a b c", "", "f(x):"]
    want = [len(re.findall(r"\w+|[^\w\s]", t)) for t in texts]
    assert evaluate(spark, texts, token_count) == want


def test_code_is_read_like_a_text_file(spark):
    texts = ["\ufeffa\r\nb\rc\n", "a\ufeff"]
    assert evaluate(spark, texts, normalise_code) == ["a\nb\nc\n", "a\ufeff"]
