"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model has a white-space marker after another character, so a text is the
sequence of its marked words (a run of markers and what follows up to the next), and each can be
segmented alone. A task segments every distinct marked word once, in a table that it empties when
full, and joins ids back by position. Only the table is per task: words need no shuffle, which
would move far more bytes than the texts have.

Null texts count as empty; an empty text has the begin and end ids only. Texts of any length are
encoded whole. Rows keep their multiplicity; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text

#: Marked words kept in a task's table, and the longest of them in characters.
TABLE_WORDS, WORD_CHARS = 100_000, 64


def check_model(model: bytes) -> None:
    """Raise unless marked words of this model can be segmented one by one."""
    if sys.byteorder != "little":
        raise ValueError("ids are packed in the machine's byte order, which must be little-endian")
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in range(pieces.get_piece_size()):
        if "▁" in pieces.id_to_piece(i).lstrip("▁"):
            raise ValueError(f"piece {pieces.id_to_piece(i)!r} crosses a white-space marker")
    if "".join(pieces.encode("  a", out_type=str)) != "▁▁▁a":
        raise ValueError("the model does not keep white space as it is")


def segmenter(model: bytes) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids, begin and end included, as little-endian 32-bit integers."""
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    runs = re.compile(" +[^ ]*").findall
    begin = array("I", [pieces.bos_id()]).tobytes()
    end = array("I", [pieces.eos_id()]).tobytes()
    # Words stand in the table without their first marker, which the encoder adds by itself, except
    # to an empty word: that one has a fixed place.
    single = {"": array("I", [pieces.piece_to_id("▁")]).tobytes()}
    table = dict(single)

    def marked_words(text: str) -> list[str]:
        if not text:
            return []
        text = text.replace("▁", " ")
        if text[0] != " " and "  " not in text:
            return text.split(" ")
        return [run[1:] for run in runs(" " + text)]

    def encode(texts: list[str]) -> list[bytes]:
        words = list(map(marked_words, texts))
        if len(table) > TABLE_WORDS:
            table.clear()
            table.update(single)
        new = list(set().union(*words).difference(table))
        found = pieces.encode(new, num_threads=1)
        table.update(zip(new, [array("I", ids).tobytes() for ids in found]))
        encoded = [b"".join([begin, *map(table.__getitem__, own), end]) for own in words]
        for word in new:
            if len(word) > WORD_CHARS:
                del table[word]
        return encoded

    return encode


def encode_decode(
    rows: DataFrame, model: bytes, text: str = "text", passed: dict[str, Column] | None = None
) -> DataFrame:
    """The passed columns (doc_id unless given), `ids` (binary: 32-bit little-endian) and `decoded`."""
    check_model(model)

    def factory():
        encode = segmenter(model)
        decode = sentencepiece.SentencePieceProcessor(model_proto=model).decode

        def of_texts(texts: list[str]) -> list[tuple]:
            return [(ids, decode(np.frombuffer(ids, "<u4").tolist())) for ids in encode(texts)]

        return of_texts

    return map_text(rows, text, passed, "ids binary, decoded string", factory)


def digests() -> list[Column]:
    """Count and digests of the columns that `encode_decode` makes."""
    return [
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]
