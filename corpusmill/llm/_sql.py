"""Pieces of DuckDB SQL that several queries of this subpackage share."""

from __future__ import annotations


def crc32_sql(column: str) -> str:
    """The unsigned CRC-32 of an integer in decimal, which DuckDB has no function for: one reduction over bytes, one over bits."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({column}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
        "lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
    )
