"""Clades and lineages from aligned amino acids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import aa_at

# A clade holds when all residues (1-based positions) do; reported in this order.
H3_CLADES = (
    ("3C.3", "158N 159F"), ("3A", "138S 159S 225D 326R"), ("3B", "62K 83R 261Q"), ("2A", "158N 159Y"), ("2A1", "158N 159Y 171K 406V 484E"),
    ("2A1A", "121K 135K 158N 159Y 171K 406V 479E 484E"), ("2A1B", "92R 121K 158N 159Y 171K 311Q 406V 484E"), ("2A2", "131K 142K 158N 159Y 261Q"),
    ("2A3", "121K 135K 144K 150K 158N 159Y 261Q"), ("2A4", "31S 53N 142G 144R 158N 159Y 171K 192T 197H"), ("GLY", "160S"), ("GLY", "160T"),
    ("159S", "159S"), ("159F", "159F"), ("159Y", "159Y"),
)
H1_CLADES = (("6B", "163Q"), ("6B1", "163Q 162N"), ("6B2", "163Q 152T"))


def has_residues(aa: Column, shift: Column, residues: str) -> Column:
    """``142N 283Q``: all of them."""
    return reduce(lambda a, b: a & b, (aa_at(aa, shift, int(r[:-1])) == r[-1] for r in residues.split()))


def _by_rules(aa: Column, shift: Column, rules) -> Column:
    return F.array_compact(F.array(*(F.when(has_residues(aa, shift, r), name) for name, r in rules)))


def h3(aa: Column, shift: Column) -> Column:
    return _by_rules(aa, shift, H3_CLADES)


def h1(aa: Column, shift: Column) -> Column:
    return _by_rules(aa, shift, H1_CLADES)


def b_yamagata(aa: Column, shift: Column) -> Column:
    """N or Y at position 166 (by the Victoria numbering), if that is not the first residue."""
    at = aa_at(aa, shift, 166)
    return F.when(shift >= 165, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.when(at == "N", "Y2").when(at == "Y", "Y3"))))


def b_victoria(aa: Column, shift: Column) -> Column:
    at = lambda p: aa_at(aa, shift, p)
    clade = F.when((at(75) == "K") & (at(172) == "P") & ~at(58).isin("P"), "1A").when(at(58) == "P", "1B").otherwise("1")
    gap = lambda p: at(p) == "-"
    deletion = F.when(gap(162) & gap(163) & gap(164), "TRIPLEDEL2017").when(gap(162) & gap(163), "DEL2017")
    return F.array_compact(F.array(clade, deletion))


def clades(virus_type: Column, lineage: Column, aa: Column, shift: Column, stored: Column) -> Column:
    """By type and lineage; other types and sequences that are not aligned keep what is stored."""
    case = (
        F.when(shift.isNull(), stored).when(virus_type == "A(H1N1)", h1(aa, shift)).when(virus_type == "A(H3N2)", h3(aa, shift))
        .when((virus_type == "B") & (lineage == "YAMAGATA"), b_yamagata(aa, shift)).when((virus_type == "B") & (lineage == "VICTORIA"), b_victoria(aa, shift))
    )
    return case.otherwise(stored)


def b_lineage(aa: Column, shift: Column) -> Column:
    """YAMAGATA if position 162 is no gap and one of 163 to 166 is, else VICTORIA; null where 166 is not reached."""
    at = lambda p: aa_at(aa, shift, p)
    gap = (at(163) == "-") | (at(164) == "-") | (at(165) == "-") | (at(166) == "-")
    return F.when(shift.isNull() | (at(162) == " ") | (at(166) == " "), None).when((at(162) != "-") & gap, "YAMAGATA").otherwise("VICTORIA")
