"""Nucleotide and amino acid strings: shifts, residues, translation, distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = "TCAG"


def _residues() -> str:
    """The standard code, codons in TCAG order. Fixed values."""
    return "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


CODONS = {a + b + c: _residues()[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
CODONS |= {k.replace("T", "U"): v for k, v in list(CODONS.items())}
CODONS |= dict.fromkeys(("TAR", "TRA", "UAR", "URA"), "*")


def is_nucleotides(c: Column) -> Column:
    return c.rlike("^[-ABCDGHKMNRSTUVWXY]*$")


def left_shift(c: Column, shift: Column, fill: str) -> Column:
    """A negative shift drops residues in front, a positive one puts ``fill`` there."""
    return F.when(shift < 0, F.substr(c, (1 - shift).cast("int"))).otherwise(F.concat(F.repeat(F.lit(fill), shift), c))


def resize(c: Column, size: Column | int, fill: str) -> Column:
    return F.rpad(c, F.lit(size) if isinstance(size, int) else size, F.lit(fill))


def nucleotides(nuc: Column, shift: Column, left: int = 0, size: int | None = None) -> Column:
    """Aligned nucleotides with ``left`` more positions in front; null where not aligned."""
    out = left_shift(nuc, shift + left, "-")
    return resize(out, size, "-") if size else out


def longest_open_part(c: Column) -> Column:
    """The first longest part without ``*``; parts before it become X, what follows is cut."""
    parts = F.split(c, r"\*", -1)
    longest = F.array_max(F.transform(parts, F.length))
    at = F.array_position(F.transform(parts, F.length), longest)
    before = F.aggregate(F.slice(parts, F.lit(1), (at - 1).cast("int")), F.lit(0), lambda a, p: a + F.length(p) + 1)
    return F.concat(F.repeat(F.lit("X"), before), F.element_at(parts, at.cast("int")))


def amino_acids(aa: Column, shift: Column, left: int = 0, size: int | None = None) -> Column:
    """Aligned amino acids; null where not aligned."""
    out = longest_open_part(left_shift(aa, shift + left, "X"))
    return resize(out, size, "X") if size else out


def residue_at(aa: Column, shift: Column, pos: Column | int, strict: bool = False) -> Column:
    """The residue at a 1-based aligned position; outside: ``?``, or an error if ``strict``."""
    at = (F.lit(pos) if isinstance(pos, int) else pos) - shift
    inside = (at >= 1) & (at <= F.length(aa))
    return F.when(inside, F.substring(aa, at, 1) if not isinstance(at, Column) else F.substr(aa, at.cast("int"), F.lit(1))).otherwise(F.raise_error(F.lit("position outside the sequence")) if strict else F.lit("?"))


def aa_at(aa: Column, shift: Column, pos: int) -> Column:
    """As ``residue_at``, a blank outside."""
    at = F.lit(pos) - shift
    return F.when((at >= 1) & (at <= F.length(aa)), F.substr(aa, at.cast("int"), F.lit(1))).otherwise(" ")


def positions(n: Column) -> Column:
    """1..n, empty for 0 (where a plain sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def letters(c: Column) -> Column:
    """The characters of a string as an array, found in one pass; empty for an empty string."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def _count(a: Column, b: Column, same) -> Column:
    # positions past the shorter end pair with null, which no comparison holds for
    return F.size(F.filter(F.zip_with(letters(a), letters(b), same), lambda hit: hit))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions over the shorter length."""
    return _count(a, b, lambda x, y: x != y)


def common(a: Column, b: Column) -> Column:
    """Equal positions that are neither X nor a gap."""
    return _count(a, b, lambda x, y: (x == y) & ~x.isin("X", "-"))


def code_points(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and the n+1 offsets (null: empty)."""
    plain = texts.fillna("")
    return np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(plain.str.len().to_numpy(np.int64))])


@F.pandas_udf(T.IntegerType())
def hamming_bulk(a: pd.Series, b: pd.Series) -> pd.Series:
    """``hamming`` for long strings, a batch at a time; null where either is null."""
    (x, x_at), (y, y_at) = code_points(a), code_points(b)
    n = np.minimum(np.diff(x_at), np.diff(y_at))
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    far = np.bincount(row[x[x_at[row] + inner] != y[y_at[row] + inner]], minlength=len(n))
    return pd.Series(far, dtype="Int32").mask(a.isna().to_numpy() | b.isna().to_numpy())


def translate_text(nuc: str, offset: int = 0) -> str:
    """Codon by codon from ``offset``; unknown and partial codons are X."""
    return "".join(CODONS.get(nuc[i : i + 3], "X") for i in range(offset, len(nuc), 3))


def translate(nuc: Column, offset: int = 0) -> Column:
    """The same as an expression."""
    table = F.create_map(*(F.lit(x) for kv in CODONS.items() for x in kv))
    codons = F.regexp_extract_all(F.substr(nuc, F.lit(offset + 1)), F.lit("(?s).{1,3}"), F.lit(0))
    return F.array_join(F.transform(codons, lambda x: F.coalesce(F.try_element_at(table, x), F.lit("X"))), "")


def _codon_table() -> tuple[np.ndarray, np.ndarray]:
    """A small number for each code point (0: no letter of a codon), and the residue of three such numbers."""
    letters = sorted({x for codon in CODONS for x in codon})
    number = np.zeros(256, np.int64)
    for k, x in enumerate(letters, 1):
        number[ord(x)] = k
    n = len(letters) + 1
    residue = np.full(n**3, ord("X"), np.uint8)
    for (x, y, z), aa in CODONS.items():
        residue[(number[ord(x)] * n + number[ord(y)]) * n + number[ord(z)]] = ord(aa)
    return number, residue


def translate_three(nuc: pd.Series) -> list[tuple[str, str, str]]:
    """All texts in the three frames, as ``translate_text`` gives them (null: empty)."""
    number, residue = _codon_table()
    n = round(len(residue) ** (1 / 3))
    points, at = code_points(nuc)
    small = np.concatenate([np.where(points < 256, number[np.minimum(points, 255)], 0), np.zeros(2, np.int64)])
    coded = residue[(small[:-2] * n + small[1:-1]) * n + small[2:]]  # of the codon that begins at each place
    ends = np.repeat(at[1:], np.diff(at))
    coded[np.arange(len(coded)) + 3 > ends] = ord("X")  # not a whole one
    text = coded.tobytes().decode("latin-1")
    return [(text[i:j:3], text[i + 1 : j : 3], text[i + 2 : j : 3]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_THREE = T.StructType([T.StructField(f"frame_{k}", T.StringType()) for k in range(3)])


@F.pandas_udf(_THREE)
def _three(nuc: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(translate_three(nuc), columns=_THREE.names)


def translate_frames(nuc: Column | str) -> Column:
    """All three frames, a batch at a time: an array of (frame, aa); null for null."""
    three, c = _three(nuc), F.col(nuc) if isinstance(nuc, str) else nuc
    return F.when(c.isNotNull(), F.array(*(F.struct(F.lit(k).alias("frame"), three[f"frame_{k}"].alias("aa")) for k in range(3))))


def insert_gaps(c: Column, gaps: Column, width: int = 1) -> Column:
    """Put runs of ``-`` (structs pos, n; 0-based, in order) into a string; positions past the end are clamped."""
    def put(text, gap):
        at = F.least(gap["pos"] * width, F.length(text))
        return F.concat(F.substr(text, F.lit(1), at), F.repeat(F.lit("-"), gap["n"] * width), F.substr(text, at + 1))
    return F.aggregate(gaps, c, put)


def against_master(c: Column, master: Column) -> Column:
    """``·`` where the residue equals the master's."""
    marked = F.zip_with(letters(c), letters(master), lambda x, y: F.when(x == y, F.lit("·")).otherwise(x))
    return F.array_join(marked, "")  # past the end of ``c`` there is null, which is left out


def damaged_codons(nuc: Column, base: Column, codons: int = 13) -> Column:
    """How many of the last codons fit the base badly (0: none): the first k from ``codons`` down to 2 whose distance exceeds the next
    shorter tail's and is at least k."""
    n = F.length(nuc)
    tail = lambda s, k: F.substr(s, F.greatest(F.lit(1), n - k * 3 + 1), k * 3)
    bad = F.filter(F.transform(F.sequence(F.lit(codons), F.lit(2)), lambda k: F.struct(k.alias("k"), hamming(tail(nuc, k), tail(base, k)).alias("d"), hamming(tail(nuc, k - 1), tail(base, k - 1)).alias("e"))), lambda x: (x["d"] > x["e"]) & (x["d"] >= x["k"]))
    return F.when(n < codons * 3, 0).otherwise(F.coalesce(F.get(bad, F.lit(0))["k"], F.lit(0)))


def blank_end(c: Column, n: Column, fill: str) -> Column:
    """The last n letters become ``fill``."""
    return F.rpad(F.substr(c, F.lit(1), F.length(c) - n), F.length(c), F.lit(fill))


def mask_damaged_end(nuc: Column, base: Column, codons: int = 13) -> Column:
    """Damaged codons at the end become gaps."""
    return blank_end(nuc, damaged_codons(nuc, base, codons) * 3, "-")


def residues_from(aa: Column, shift: Column, pos: int, n: int | None = None) -> Column:
    """The aligned residues from a position (from 1) on, all or n of them."""
    at = F.greatest(F.lit(1), F.lit(pos) - shift).cast("int")
    return F.substr(aa, at, F.lit(n)) if n is not None else F.substr(aa, at)


def residues_before(aa: Column, shift: Column, pos: int) -> Column:
    """The aligned residues in front of a position."""
    return F.substr(aa, F.lit(1), F.greatest(F.lit(0), F.lit(pos - 1) - shift).cast("int"))


def name_from_template(template: str, fields: dict[str, Column]) -> Column:
    """``{field}`` placeholders filled from columns."""
    import string

    parts: list[Column] = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            parts.append(F.coalesce(fields[field].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
