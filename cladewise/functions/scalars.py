"""Small scalar functions: seed masks, sizes, ranks, lineages, identifiers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks that have a letter, in report order.
RANK_LETTERS = {"superkingdom": "D", "kingdom": "K", "phylum": "P", "class": "C", "order": "O", "family": "F", "genus": "G", "species": "S"}
# Size suffixes.
SIZE_UNITS = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30}
BYTE_SUFFIXES = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]


def seed_template(length: int, spaces: int) -> str:
    """Ones, then ``spaces`` times 01: which letters of a minimizer count."""
    if spaces > length // 4:
        raise ValueError(f"{spaces} spaces exceed a quarter of the minimizer length {length}")
    return "1" * (length - 2 * spaces) + "01" * spaces


def seed_template_col(length: Column, spaces: Column) -> Column:
    """As ``seed_template``; null where there are too many spaces."""
    template = F.concat(F.repeat(F.lit("1"), (length - 2 * spaces).cast("int")), F.repeat(F.lit("01"), spaces.cast("int")))
    return F.when(spaces <= F.floor(length / 4), template)


def parse_binary(text: str) -> int:
    return int(text, 2)


def parse_binary_col(text: Column) -> Column:
    return F.conv(text, 2, 10).cast("long")


def expand_mask(mask: int, factor: int) -> int:
    """Each bit of the mask ``factor`` times; unchanged for a factor of 0 or above 64."""
    if not 0 < factor <= 64:
        return mask
    wide = (1 << factor) - 1
    return sum(wide << factor * i for i in range(64 // factor) if mask >> i & 1) & (1 << 64) - 1


def expand_mask_col(mask: Column, factor: int) -> Column:
    """As ``expand_mask``, on all 64 bits of a BIGINT."""
    if not 0 < factor <= 64:
        return mask
    wide = F.lit((1 << factor) - 1 if factor < 64 else -1).cast("long")
    bits = [F.shiftleft(F.call_function("getbit", mask.cast("long"), F.lit(i)).cast("long") * wide, factor * i) for i in range(64 // factor)]
    return reduce(Column.bitwiseOR, bits)


def seed_mask(length: int, spaces: int) -> int:
    """The spaced-seed mask over 2-bit letters."""
    return expand_mask(parse_binary(seed_template(length, spaces)), 2)


def parse_size(text: str) -> int:
    m = re.fullmatch(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)([KMGkmg])", text)
    if not m:
        raise ValueError(f"invalid size {text!r}: a number and K, M or G are expected")
    return max(0, int(float(m[1]) * SIZE_UNITS[m[2].upper()]))


def parse_size_col(text: Column) -> Column:
    """Bytes of 1.5G, 250M, 1024k; null for anything else."""
    number = F.regexp_extract(text, r"^([0-9]+\.?[0-9]*)[KMGkmg]$", 1)
    unit = F.upper(F.right(text, F.lit(1)))
    factor = F.coalesce(*[F.when(unit == k, F.lit(float(v))) for k, v in SIZE_UNITS.items()])
    return F.when(number != "", F.floor(number.try_cast("double") * factor)).cast("long")


def format_bytes(size: float) -> str:
    i = 0
    while size >= 1024 and i < len(BYTE_SUFFIXES) - 1:
        size, i = size / 1024, i + 1
    return f"{size:.2f}{BYTE_SUFFIXES[i]}"


def format_bytes_col(size: Column) -> Column:
    """As ``format_bytes`` (ties of the last place to the even digit, which ``format_string`` rounds up); null for null."""
    text = lambda i: F.concat(F.call_function("format_number", size.cast("double") / float(1 << 10 * i), F.lit("0.00")), F.lit(BYTE_SUFFIXES[i]))
    out = text(len(BYTE_SUFFIXES) - 1)
    for i in reversed(range(len(BYTE_SUFFIXES) - 1)):
        out = F.when(size < float(1 << 10 * (i + 1)), text(i)).otherwise(out)
    return out


def zero_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0))


def required_score(confidence: Column, n: Column) -> Column:
    """Hits that a clade needs: the confidence's share of all positions, rounded up."""
    return F.ceil(confidence.cast("double") * n.cast("double")).cast("long")


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def rank_letter(rank: Column) -> Column:
    """The report's letter of a rank, null if it has none."""
    return F.coalesce(*[F.when(rank == k, F.lit(v)) for k, v in RANK_LETTERS.items()])


def rank_code(ranks: Column) -> Column:
    """Report code from the ranks root..self: the nearest letter and the number of levels below it; the root starts at R, -1."""
    step = lambda acc, r: F.when(rank_letter(r).isNotNull(), F.struct(rank_letter(r).alias("l"), F.lit(0).alias("n"))).otherwise(F.struct(acc["l"].alias("l"), (acc["n"] + 1).alias("n")))
    end = F.aggregate(ranks, F.struct(F.lit("R").alias("l"), F.lit(-1).alias("n")), step)
    return F.when(end["n"] == 0, end["l"]).otherwise(F.concat(end["l"], end["n"].cast("string")))


def lineage(ranks: Column, names: Column) -> Column:
    """rank:name > rank:name, root first."""
    return F.array_join(F.zip_with(ranks, names, lambda r, n: F.concat(r, F.lit(":"), n)), " > ")


def mpa_lineage(ranks: Column, names: Column) -> Column:
    """d__X|p__Y over the ranks that have a letter."""
    parts = F.zip_with(ranks, names, lambda r, n: F.concat(F.lower(rank_letter(r)), F.lit("__"), n))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "|")


def trim_pair(read_id: Column) -> Column:
    return F.regexp_replace(read_id, "/[12]$", "")


def pair_text(first: Column, second: Column) -> Column:
    """a, or a|b for pairs."""
    return F.concat_ws("|", first.cast("string"), second.cast("string"))


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two arrays."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.slice(a, F.lit(1), F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int"))


def lowest_common_path(path: Column) -> Column:
    """Aggregate: the path of the lowest common ancestor. All paths lie between the least and the greatest, so their common prefix is
    that of those two; both are partial aggregates."""
    return common_prefix(F.min(path), F.max(path))
