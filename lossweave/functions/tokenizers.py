"""Tokenizers as column functions from a string to an array of ids, and back to the text of each id."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F

Encode = Callable[[Column], Column]
#: From an array of ids to an array of their texts, one for each.
Decode = Callable[[Column], Column]


def code_points(shift: int = 10) -> Encode:
    """One id per code point; stays in the JVM."""
    return lambda text: F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.ascii(c) + shift).cast("int"))


def pieces(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda x: x != "")


def arrow(encode_batch: Callable[[list[str]], list[list[int]]]) -> Encode:
    """Any Python tokenizer, fed with Arrow batches; ``encode_batch`` must add no special tokens."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        known = [t or "" for t in texts.to_pylist()]
        return pa.array(encode_batch(known), pa.list_(pa.int32()))

    return lambda text: encode(text)


def code_point_texts(shift: int = 10) -> Decode:
    """The texts of ``code_points``; stays in the JVM."""
    return lambda ids: F.transform(ids, lambda x: F.decode(F.unhex(F.lpad(F.hex(x - shift), 8, "0")), "UTF-32"))


def arrow_texts(decode_batch: Callable[[list[list[int]]], list[list[str]]]) -> Decode:
    """Any Python tokenizer's texts; ``decode_batch`` must give one text for each id."""

    @F.arrow_udf("array<string>")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array(decode_batch([x or [] for x in ids.to_pylist()]), pa.list_(pa.string()))

    return lambda ids: decode(ids)


def token_info(ids: Column, positions: Column, decode: Decode) -> Column:
    """For each of the positions in a sequence of ids: its number among them, the position, the id and its text."""
    def told(at, i):
        token = F.get(ids, at)
        return F.struct(i.alias("response_token_index"), at.alias("sequence_token_index"), token.alias("token_id"))

    known = F.transform(positions, told)
    texts = decode(F.transform(positions, lambda at: F.get(ids, at)))
    return F.zip_with(known, texts, lambda x, t: F.struct(x["response_token_index"], x["sequence_token_index"], x["token_id"], t.alias("token_text")))
