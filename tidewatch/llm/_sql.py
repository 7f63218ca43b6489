"""DuckDB texts that the SQL of several corpus operators needs."""

from __future__ import annotations

#: One row with the 256 steps of the CRC-32 of RFC 1952, built from its polynomial.
CRC_TABLE = "select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) as steps"


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; the query must join the one row of ``CRC_TABLE``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"
