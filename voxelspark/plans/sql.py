"""DuckDB text of expressions that many oracle queries share."""

from __future__ import annotations

from ..functions.morton import MAX_COORD, SPREAD


def expand(x: str) -> str:
    out = f"(({x})::BIGINT & {MAX_COORD - 1})"
    for shift, mask in SPREAD:
        out = f"(({out} | ({out} << {shift})) & {mask})"
    return out


def code(x: str, y: str, z: str) -> str:
    """Bit by bit, which stays short: three bits for each of the 19 places."""
    bits = [f"(((({c})::BIGINT >> {k}) & 1) << {3 * k + j})" for j, c in enumerate((x, y, z)) for k in range(19)]
    return "(" + " | ".join(bits) + ")"


def decode(c: str, axis: int) -> str:
    return "(" + " | ".join(f"((({c} >> {3 * k + axis}) & 1) << {k})" for k in range(19)) + ")"


def at(c: str, scale: str) -> str:
    """A code without the bits below scale."""
    return f"((({c}) >> (3 * ({scale}))) * (1::BIGINT << (3 * ({scale}))))"


def key(c: str, scale: str) -> str:
    return f"({at(c, scale)} * 32 + ({scale}))"


#: Voxel keys from lineitem: code, scale, key and coordinates.
KEYS = f"""
c AS (SELECT l_orderkey, l_linenumber, l_partkey % 512 AS x, l_suppkey % 512 AS y, l_linenumber % 512 AS z, CAST(l_orderkey % 4 AS BIGINT) AS scale FROM lineitem),
e AS (SELECT *, {code("x", "y", "z")} AS code FROM c),
k AS (SELECT *, {key("code", "scale")} AS key FROM e)"""
#: Distinct keys of scale 3 with all their ancestors up to the root of a map of 512 voxels.
TREE = f"""{KEYS},
b AS (SELECT DISTINCT {at("code", "3")} AS code FROM k),
o AS (SELECT DISTINCT {at("code", "s.scale")} AS code, s.scale FROM b, (SELECT CAST(range AS BIGINT) AS scale FROM range(3, 10)) s),
m AS (SELECT {at("code", "scale + 1")} AS code, scale + 1 AS scale, CAST(bit_or(1 << CAST((code >> (3 * scale)) & 7 AS INTEGER)) AS INTEGER) AS child_mask FROM o GROUP BY 1, 2),
t AS (SELECT {key("o.code", "o.scale")} AS key, o.code, o.scale, o.scale = 3 AS is_block, coalesce(child_mask, 0) AS child_mask FROM o LEFT JOIN m ON m.code = o.code AND m.scale = o.scale)"""
