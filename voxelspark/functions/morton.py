"""Morton codes and keys of octants as Column functions.

A code interleaves three 19-bit coordinates (x in bit 0, y in bit 1, z in bit 2). A key is
a code without the bits below its scale, shifted left by 5, with the scale in the low 5
bits; it is never negative in a BIGINT. Descendants of an octant at scale s have the
codes [code, code + 8^s), so ancestry is a range test and parents are bit arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COORD_BITS, SCALE_BITS = 19, 5
#: Scales that a code can be masked to.
MAX_SCALE = COORD_BITS - 1
MAX_COORD = 1 << COORD_BITS
#: Shift and mask of each step that spreads 19 bits to every third bit.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _shl(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x.cast("long"), F.lit(n).cast("int") if isinstance(n, int) else n.cast("int"))


def _shr(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", x.cast("long"), F.lit(n).cast("int") if isinstance(n, int) else n.cast("int"))


def expand(x: Column) -> Column:
    """Spread 19 bits to every third bit."""
    out = x.cast("long").bitwiseAND(F.lit(MAX_COORD - 1))
    for shift, mask in SPREAD:
        out = out.bitwiseOR(_shl(out, shift)).bitwiseAND(F.lit(mask))
    return out


def compact(x: Column) -> Column:
    """Gather every third bit; the inverse of expand()."""
    masks = [MAX_COORD - 1, *(m for _, m in SPREAD)]
    out = x.bitwiseAND(F.lit(masks[-1]))
    for k in range(len(SPREAD) - 1, -1, -1):
        out = out.bitwiseOR(_shr(out, SPREAD[k][0])).bitwiseAND(F.lit(masks[k]))
    return out


def encode_code(x: Column, y: Column, z: Column) -> Column:
    return expand(x).bitwiseOR(_shl(expand(y), 1)).bitwiseOR(_shl(expand(z), 2))


def decode_code(code: Column) -> tuple[Column, Column, Column]:
    return compact(code), compact(_shr(code, 1)), compact(_shr(code, 2))


def code_at_scale(code: Column, scale: Column) -> Column:
    """The code without the bits below scale."""
    return _shl(_shr(code, 3 * scale), 3 * scale)


def encode_key(code: Column, scale: Column) -> Column:
    return _shl(code_at_scale(code, scale), SCALE_BITS).bitwiseOR(scale.cast("long"))


def is_lossless(code: Column, scale: Column) -> Column:
    """Whether the code has no detail below scale."""
    return code_at_scale(code, scale) == code


def key_code(key: Column) -> Column:
    return _shr(key, SCALE_BITS)


def key_scale(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << SCALE_BITS) - 1)).cast("int")


def key_coord(key: Column) -> tuple[Column, Column, Column]:
    return decode_code(key_code(key))


def is_valid_key(key: Column, limit: int = MAX_SCALE) -> Column:
    scale = key_scale(key)
    return (key >= 0) & (scale <= limit) & is_lossless(key_code(key), scale)


def is_valid_coord(x: Column, y: Column, z: Column) -> Column:
    inside = lambda c: (c >= 0) & (c < MAX_COORD)
    return inside(x) & inside(y) & inside(z)


def child_index(code: Column, scale: Column) -> Column:
    """Which child of its parent the octant at this scale is, as x + 2y + 4z."""
    return _shr(code, 3 * scale).bitwiseAND(F.lit(7)).cast("int")


def key_at_scale(key: Column, scale: Column) -> Column:
    """The ancestor at scale; null where the key is already coarser."""
    return F.when(key_scale(key) <= scale, encode_key(key_code(key), scale))


def parent_key(key: Column) -> Column:
    return encode_key(key_code(key), key_scale(key) + 1)


def block_key(key: Column, block_scale: int = 3) -> Column:
    """The key without the coordinate bits inside its block; it keeps its own scale."""
    scale = key_scale(key)
    return _shl(code_at_scale(key_code(key), F.lit(block_scale)), SCALE_BITS).bitwiseOR(scale.cast("long"))


def child_key(key: Column, child: Column) -> Column:
    scale = key_scale(key) - 1
    return encode_key(key_code(key).bitwiseOR(_shl(child, 3 * scale)), scale)


def descendants_end(code: Column, scale: Column) -> Column:
    """The first code after those of the octant's descendants."""
    return code + _shl(F.lit(1), 3 * scale)


def is_descendant(child: Column, parent: Column) -> Column:
    """Whether child lies strictly below parent."""
    finer = key_scale(child) < key_scale(parent)
    return finer & (code_at_scale(key_code(child), key_scale(parent)) == key_code(parent))


def is_sibling(a: Column, b: Column) -> Column:
    """Whether two keys have one scale and one parent; a key is its own sibling."""
    return (key_scale(a) == key_scale(b)) & (parent_key(a) == parent_key(b))


def octant_size(scale: Column) -> Column:
    return _shl(F.lit(1), scale).cast("int")


def size_to_scale(size: Column) -> Column:
    return F.round(F.log2(size.cast("double"))).cast("int")
