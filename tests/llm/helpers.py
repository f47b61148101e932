"""Tables for the tests of the corpus operators."""

from __future__ import annotations

import os

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use themselves.
CLASHING = ("fp", "row", "__text", "ids", "found", "kept", "number", "masked", "passed", "items", "label", "key")

WORDS = "the sun rose over quiet hills while small birds sang near old stone walls and water ran".split()


def documents(spark, texts, clashing=False, ids=None):
    """One document for each text, numbered from 0 unless ids are given."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, DOCS)
    if clashing:
        for name in CLASHING:
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def prose(seed: int, words: int = 60) -> str:
    """Invented prose that shares no shingle with that of other seeds."""
    return " ".join(f"{WORDS[(seed * 7 + i * (seed % 5 + 1)) % len(WORDS)]}{seed}x{i}" for i in range(words))


#: Null, empty, blank, repeated, odd and long texts.
ODD_TEXTS = [
    None, "", " ", "\n\t \n", "a", "A b", "a a a a a a", "é ü  日本\n\n😀 ok", "▁ ▁▁x", "\x00 null", "x" * 5000,
    "word " * 3000, "</s>[INST] \\ <|im_end|>\n", "1" * 4000, "@" * 300, "same text here", "same text here",
]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
