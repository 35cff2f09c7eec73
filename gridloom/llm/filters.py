"""A filter of fixed size that keeps most rows without a partner out of a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_WORD_BITS = 18  # 2^18 words of 64 bits: 4 MB sent out, whatever the number of ids


def rows_with_ids(rows: DataFrame, ids: DataFrame, id_col: str, keep: bool = True) -> DataFrame:
    """Rows whose id may be in ``ids``; all that are, and of the others fewer the fewer ids.

    With ``keep=False`` the other rows, whose id is certainly not there or NULL.

    The ids are set in a table of bits by their hash, which has a fixed size and is sent out;
    with very many ids all bits are set and every row passes. Join the result as usual.
    """
    digest = F.xxhash64(F.col(id_col))
    word = digest.bitwiseAND(F.lit((1 << _WORD_BITS) - 1)).cast("int")
    bit = F.shiftrightunsigned(digest, _WORD_BITS).bitwiseAND(F.lit(63)).cast("int")
    marked = ids.select(word.alias("_word"), bit.alias("_bit")).distinct()
    bits = marked.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    rows = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word", "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(_bits, _bit) & 1L") == 1, F.lit(False))
    hit &= F.col(id_col).isNotNull()
    return rows.where(hit if keep else ~hit).drop("_word", "_bit", "_bits")
