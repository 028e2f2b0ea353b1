"""Packed DNA as column expressions: two bits a base, A C G T as 0 to 3, the first base most significant, up to 31 bases in a BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 31  # 32 bases fill the sign bit, where the order of numbers and of strings part


def check_length(length: int) -> int:
    """Barcodes have one length from 1 to LONGEST."""
    if not 1 <= length <= LONGEST:
        raise ValueError(f"a barcode has 1 to {LONGEST} bases, not {length}")
    return length


def pack(dna: Column) -> Column:
    """The number of a DNA string; A and any letter that is no base count as 0."""
    bases = F.transform(F.split(F.upper(dna), ""), lambda c: F.when(c == "C", 1).when(c == "G", 2).when(c == "T", 3).otherwise(0).cast("long"))
    return F.aggregate(bases, F.lit(0).cast("long"), lambda acc, c: acc * 4 + c)


def unpack(code: Column, length: int) -> Column:
    """The DNA string of a number."""
    check_length(length)
    return F.concat(*(F.substring(F.lit("ACGT"), (F.shiftright(code, 2 * (length - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(length)))


def reverse_complement(dna: Column) -> Column:
    """Of a DNA string; other letters stay."""
    return F.reverse(F.translate(dna, "ACGTacgt", "TGCAtgca"))


def reverse_complement_packed(code: Column, length: int) -> Column:
    """Of a packed number."""
    check_length(length)
    out = F.lit(0).cast("long")
    for i in range(length):
        base = F.lit(3) - F.shiftright(code, 2 * i).bitwiseAND(F.lit(3))
        out = out + F.shiftleft(base.cast("long"), 2 * (length - 1 - i))
    return out


def substitutions(code: Column, length: int) -> Column:
    """All numbers that differ in exactly one base, as an array of 3 * length."""
    check_length(length)
    return F.array(*(code.bitwiseXOR(F.lit(x << (2 * i)).cast("long")) for i in range(length) for x in (1, 2, 3)))


def shifts(code: Column, length: int) -> Column:
    """The directed one-base shifts: for each boundary, the lower part moves by a base and any base is admitted at its end.

    Moving up keeps the upper part, so the base that crosses the boundary is OR-ed into it. The relation is not symmetric.
    """
    check_length(length)
    out = []
    for b in range(1, length):
        mask = (1 << (2 * b)) - 1
        upper, lower = code.bitwiseAND(F.lit(~mask).cast("long")), code.bitwiseAND(F.lit(mask).cast("long"))
        for base in range(4):
            out.append(upper.bitwiseOR(F.lit(base << (2 * (b - 1))).cast("long")).bitwiseOR(F.shiftright(lower, 2)))
            out.append(upper.bitwiseOR(F.lit(base).cast("long")).bitwiseOR(F.shiftleft(lower, 2)))
    if not out:
        return F.array().cast("array<bigint>")
    return F.filter(F.array_distinct(F.array(*out)), lambda x: x != code)


def neighbours(code: Column, length: int, kind: str) -> Column:
    """The neighbourhood of a retained barcode: 'hamming-1' or 'substitution-or-shift-1' (also called 'edit-1')."""
    if kind == "hamming-1":
        return substitutions(code, length)
    if kind in ("substitution-or-shift-1", "edit-1"):
        return F.array_union(substitutions(code, length), shifts(code, length))
    raise ValueError(f"no neighbourhood {kind!r}")


def differing_bases(a: Column, b: Column) -> Column:
    """In how many bases two packed numbers differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


# Genes with splicing states: an even id is the spliced form, id + 1 the unspliced one.
def is_spliced(gid: Column) -> Column:
    return gid % 2 == 0


def same_gene(a: Column, b: Column) -> Column:
    return F.shiftright(a, 1) == F.shiftright(b, 1)
