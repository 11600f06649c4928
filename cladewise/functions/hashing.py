"""64-bit hashes and cell packing as column expressions.

BIGINT carries unsigned 64-bit values. ANSI mode makes ``*`` and ``+`` raise on overflow, so wrapping arithmetic goes through 16- and 32-bit
limbs in built-in expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Multipliers and additive constant of the two hash functions.
FMIX_1, FMIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
MURMUR_1, MURMUR_2, MURMUR_ADD = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0x52DCE729
# Fixed value: default toggle mask of the minimizer order.
TOGGLE_MASK = 0xE37E28C4271B5A2D

U64 = (1 << 64) - 1


def signed(value: int) -> int:
    """The signed 64-bit number with the bits of an unsigned one."""
    value &= U64
    return value - (1 << 64) if value >> 63 else value


def _long(value: int) -> Column:
    return F.lit(signed(value)).cast("long")


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f names it: keeps the expression's size linear in its steps."""
    return F.element_at(F.transform(F.array(x), f), 1)


def wrapping_multiply(x: Column, by: int) -> Column:
    """x * by modulo 2^64: schoolbook multiplication of 16-bit limbs with carries."""
    return bound(x, lambda v: _multiply(v, by))


def _multiply(x: Column, by: int) -> Column:
    limbs = [F.shiftrightunsigned(x, 16 * i).bitwiseAND(_long(0xFFFF)) for i in range(4)]
    other = [by >> 16 * i & 0xFFFF for i in range(4)]
    out, carry = _long(0), _long(0)
    for place in range(4):
        total = carry
        for i in range(place + 1):
            total = total + limbs[i] * _long(other[place - i])
        out = out.bitwiseOR(F.shiftleft(total.bitwiseAND(_long(0xFFFF)), 16 * place))
        carry = F.shiftrightunsigned(total, 16)
    return out


def wrapping_add(x: Column, value: int) -> Column:
    def halves(v: Column) -> Column:
        low = v.bitwiseAND(_long(0xFFFFFFFF)) + _long(value & 0xFFFFFFFF)
        high = F.shiftrightunsigned(v, 32) + _long(value >> 32 & 0xFFFFFFFF) + F.shiftrightunsigned(low, 32)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(_long(0xFFFFFFFF)))

    return bound(x, halves)


def rotate_left(x: Column, by: int) -> Column:
    return bound(x, lambda v: F.shiftleft(v, by).bitwiseOR(F.shiftrightunsigned(v, 64 - by)))


def _fold(x: Column) -> Column:
    return bound(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 33)))


def fmix64(x: Column) -> Column:
    """Xor-shift-multiply finaliser."""
    return _fold(wrapping_multiply(_fold(wrapping_multiply(_fold(x), FMIX_1)), FMIX_2))


def murmur_hash3(x: Column) -> Column:
    """One 8-byte block of the 64-bit Murmur3 variant with seed 0."""
    block = wrapping_multiply(rotate_left(wrapping_multiply(x, MURMUR_1), 31), MURMUR_2)
    return fmix64(wrapping_add(wrapping_multiply(rotate_left(block, 27), 5), MURMUR_ADD).bitwiseXOR(_long(8)))


@contextmanager
def _wrapping(spark: SparkSession):
    """Arithmetic of plans analysed inside wraps around; a plan keeps the arithmetic it was analysed with."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _steps(df: DataFrame, x: Column, name: str, steps: list) -> DataFrame:
    """Column ``name`` from x by one projection a step, so each is computed once and all in one generated stage."""
    with _wrapping(df.sparkSession):
        df = df.withColumn(name, x)
        for step in steps:
            df = df.withColumn(name, step(F.col(name)))
    return df


_FMIX_STEPS = [
    lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 33)) * _long(FMIX_1),
    lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 33)) * _long(FMIX_2),
    lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 33)),
]
_MURMUR_STEPS = [
    lambda v: v * _long(MURMUR_1),
    lambda v: F.shiftleft(v, 31).bitwiseOR(F.shiftrightunsigned(v, 33)) * _long(MURMUR_2),
    lambda v: (F.shiftleft(v, 27).bitwiseOR(F.shiftrightunsigned(v, 37)) * 5 + _long(MURMUR_ADD)).bitwiseXOR(_long(8)),
]


def with_fmix64(df: DataFrame, x: Column, name: str = "hash") -> DataFrame:
    """Adds ``fmix64`` of x; the expression of that name is the specification, and slower."""
    return _steps(df, x, name, _FMIX_STEPS)


def with_murmur_hash3(df: DataFrame, x: Column, name: str = "hash") -> DataFrame:
    """Adds ``murmur_hash3`` of x; the expression of that name is the specification, and slower."""
    return _steps(df, x, name, _MURMUR_STEPS + _FMIX_STEPS)


def unsigned_mod(x: Column, by: Column) -> Column:
    """x as an unsigned number modulo ``by`` (below 2^62)."""
    return bound(x, lambda v: (F.shiftrightunsigned(v, 1) % by * 2 + v.bitwiseAND(_long(1))) % by)


def unsigned_at_least(x: Column, least: int) -> Column:
    flip = _long(1 << 63)
    return x.bitwiseXOR(flip) >= _long(least ^ 1 << 63)


# --- cells: the high bits of a hash beside a value -------------------------------------------------------------------


def compacted(x: Column, value_bits: int) -> Column:
    """The high 32 - value_bits bits of a hash."""
    return F.shiftrightunsigned(x, 32 + value_bits)


def cell32(x: Column, value_bits: int, value: Column) -> Column:
    """Unsigned 32-bit cell (as BIGINT): compact key and value."""
    return F.shiftleft(compacted(x, value_bits), value_bits).bitwiseOR(value.cast("long")).bitwiseAND(_long(0xFFFFFFFF))


def cell64(x: Column, value_bits: int, value: Column) -> Column:
    """64-bit cell: compact key above 32 + value_bits bits of value."""
    return F.shiftleft(compacted(x, value_bits), 32 + value_bits).bitwiseOR(value.cast("long"))


def left32(cell: Column, value_bits: int) -> Column:
    return F.shiftrightunsigned(cell, value_bits)


def right32(cell: Column, value_mask: int) -> Column:
    return cell.bitwiseAND(_long(value_mask & 0xFFFFFFFF))


def left64(cell: Column, value_bits: int) -> Column:
    return F.shiftrightunsigned(cell, 32 + value_bits)


def right64(cell: Column, value_mask: int) -> Column:
    return cell.bitwiseAND(_long(value_mask << 32 | 0xFFFFFFFF))


def combined32(left: Column, right: Column, value_bits: int) -> Column:
    return F.shiftleft(left, value_bits).bitwiseOR(right)


def slot_index(x: Column, capacity: Column | int) -> Column:
    """Place of a hash in a table of ``capacity`` cells."""
    return unsigned_mod(x, capacity if isinstance(capacity, Column) else _long(capacity))


def page_of(index: Column, page_cells: int) -> tuple[Column, Column]:
    """Page number and place in the page."""
    return F.floor(index / page_cells).cast("long"), index % page_cells


def sample_cell_index(index_in_page: Column, page: Column, index_bits: int) -> Column:
    return F.shiftleft(index_in_page, index_bits).bitwiseOR(page)


def sequence_id(cell: Column) -> Column:
    """The low 32 bits of a sample cell."""
    return cell.bitwiseAND(_long(0xFFFFFFFF))


def bits_for(n: Column) -> Column:
    """Bits that n values need: ceil(log2 n), 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.log2(n.cast("double")))).cast("int")


def taxid_bits(nodes: int, requested: int = 0) -> int:
    """Bits for node numbers; an error if fewer are requested than needed."""
    needed = max(1, math.ceil(math.log2(nodes)))
    if 0 < requested < needed:
        raise ValueError("more bits required for storing taxid")
    return max(needed, requested)


def index_bits(page_cells: int) -> int:
    return max(1, math.ceil(math.log2(page_cells)))
