"""Greedy decoding and text assembly on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The word mark of pieces, tokens a frame may emit.
MARK, PER_FRAME = "▁", 10


def argmax_last(values: Column) -> Column:
    """Index from 0 of the largest value, the last of equals."""
    return (F.size(values) - F.array_position(F.reverse(values), F.array_max(values))).cast("long")


def is_text_token(token: Column) -> Column:
    """All but ``<...>`` tokens, of which ``<unk>`` stays."""
    return ~(token.startswith("<") & token.endswith(">")) | (token == "<unk>")


def detokenise(tokens: Column, spaces: Column) -> Column:
    """Pieces joined, word marks as spaces or nothing, outer white space off."""
    joined = F.array_join(F.filter(tokens, is_text_token), "")
    text = F.when(spaces, F.replace(joined, F.lit(MARK), F.lit(" "))).otherwise(F.replace(joined, F.lit(MARK), F.lit("")))
    return trim_unicode(text)


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
