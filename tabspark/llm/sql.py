"""Pieces of SQL that the twins of several operators share."""

from __future__ import annotations


def crc32_sql(code_list: str) -> str:
    """Unsigned crc32 of a list of byte values: the bitwise definition, reflected polynomial 0xEDB88320."""
    bit = "xor(a >> 1, 3988292384 * (a & 1))"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: {bit})"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {code_list}), lambda c, b: {byte}))"


def digits_crc32_sql(number: str) -> str:
    """Unsigned crc32 of a whole number in decimal; null counts as the empty text."""
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"CASE WHEN {number} IS NULL THEN 0 ELSE {crc32_sql(codes)} END"
