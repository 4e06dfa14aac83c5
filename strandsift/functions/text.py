"""Names, passages, labs, dates and FASTA headers as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings.
VIRUS_TYPES = {
    "B": "B", "BV": "B", "BY": "B", "BVIC": "B", "BYAM": "B", "B/VIC": "B", "B/YAM": "B", "H1PDM": "A(H1N1)", "H1SEAS": "A(H1N1)", "H1": "A(H1N1)",
    "A(H1N1)": "A(H1N1)", "A(H1N2)": "A(H1N2)", "A(H1)": "A(H1)", "H3": "A(H3N2)", "A(H3N2)": "A(H3N2)", "ALL": "",
}
LABS = {"CDC": "CDC", "CNIC": "CNIC", "MELB": "MELB", "VIDRL": "MELB", "NIID": "NIID", "NIMR": "NIMR", "CRICK": "NIMR"}
LINEAGES = {"VICTORIA": "VICTORIA", "VIC": "VICTORIA", "V": "VICTORIA", "YAMAGATA": "YAMAGATA", "YAM": "YAMAGATA", "Y": "YAMAGATA", "2009PDM": "2009PDM", "SEASONAL": "SEASONAL"}
# Institutes and their codes, replaced in this order.
INSTITUTES = (
    ("Centers for Disease Control and Prevention", "CDC"), ("Crick Worldwide Influenza Centre", "NIMR"), ("National Institute for Medical Research", "NIMR"),
    ("WHO Collaborating Centre for Reference and Research on Influenza", "MELB"), ("National Institute of Infectious Diseases (NIID)", "NIID"),
    ("National Institute of Infectious Diseases", "NIID"), ("Erasmus Medical Center", "EMC"), ("WHO Chinese National Influenza Center", "CNIC"),
)
# Spellings of places in names.
PLACES = (("ITALY-FVG/", "ITALY/FVG-"), ("/LYON/CHU/", "/LYON CHU/"), ("/CAMEROON1", "/CAMEROON/1"), ("//", "/"))
# Name corrections.
NAME_FIXES = (
    (r"(?i)(/IRAN/\d+/2015)\s*\(\d.*", "$1"), (r"(?i)/MANAGUA/(\d+)_(\d+)/", "/MANAGUA/$1.$2/"), (r"(?i)\s+\([\d\-]+\)$", ""),
    (r"(?i)\s+\(VS\d+\)$", ""), (r"(?i)/(\d+)_LIKE", "/$1"), (r"(?i)^NYMC X-181$", "A/CALIFORNIA/7/2009 NYMC-181"),
)
# Passage spellings.
PASSAGE_FIXES = (
    (r"^\s*(CS|ORIGINAL)(?:\([^\)]*\))?\s*$", "OR"), (r"(?<![A-Z_])C(X|\d+)", "MDCK$1"), (r"(?<![A-Z_])S(X|\d+)", "SIAT$1"),
    (r"(?<![A-Z_])M(X|\d+)", "MK$1"), (r"(?<![A-Z_])(E|SIAT|MK|MDCK)X", "$1?"), (r"\s*,\s*", "/"),
)
# What a reassortant's number follows in a name, as patterns.
DESIGNATIONS = ("X", "BX", "NYMC X", "NYMC-X", "VI", "NIB", "NIBSC", "RESVIR", "IVR", "RG", r"RG\s*ID", "IBCDCRG", "UWRG", "PR8-IDCDC-RG")
# Beginnings of headers that give the reassortant first, and the name in parentheses.
REASSORTANT_HEADS = ("NYMC", "IVR", "BVR", "X-", "BX-", "NIB", "RG")


def _let(body, **values: Column) -> Column:
    """``body`` of a struct of values, each computed once for a row however often the body names it."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), F.lit(0))


def _regexes(c: Column, fixes) -> Column:
    return reduce(lambda x, f: F.regexp_replace(x, *f), fixes, c)


def _known(c: Column, table: dict[str, str], what: str) -> Column:
    """The table's value of a trimmed, upper-cased spelling; null stays null, an unknown one is an error."""
    key = F.upper(F.trim(c))
    value = reduce(lambda case, kv: case.when(key == kv[0], kv[1]), list(table.items())[1:], F.when(key == next(iter(table)), next(iter(table.values()))))
    return F.when(c.isNull(), None).otherwise(F.coalesce(value, F.raise_error(F.concat(F.lit(f"Unrecognized {what}: "), c))))


def virus_type(c: Column) -> Column:
    """ALL becomes '' (no filter)."""
    return _known(c, VIRUS_TYPES, "virus type")


def lab(c: Column) -> Column:
    return _known(c, LABS, "lab")


def lineage(c: Column) -> Column:
    return _known(c, LINEAGES, "lineage")


def fix_lineage(c: Column) -> Column:
    return F.when(F.upper(c) == "PDM09", "2009PDM").otherwise(F.upper(c))


def institute(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), INSTITUTES, c)


def header_type(c: Column) -> Column:
    """Two cells around a slash, a type letter and a subtype: ``A / H3N2`` -> ``A(H3N2)``, ``B / ...`` -> ``B``; anything else is an error."""
    cells = F.transform(F.split(c, "/", -1), lambda x: F.trim(x))
    letter, subtype = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
    known = (F.size(cells) == 2) & letter.isin("A", "B") & subtype.rlike(r"^H\d+N\d+$")
    made = F.when(letter == "B", "B").otherwise(F.concat(letter, F.lit("("), subtype, F.lit(")")))
    return F.when(c.isNull() | (c == ""), None).when(known, made).otherwise(F.raise_error(F.concat(F.lit("Unrecognized virus type: "), c)))


def header_name(c: Column) -> Column:
    """Upper case, places respelled, ``REASSORTANT (NAME)`` turned round; a closing parenthesis may be missing, and ``HY`` before the name goes."""
    fixed = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), PLACES, F.upper(c))

    def turn(x):
        open_end = F.when(x["inside"].endswith(")"), F.substr(x["inside"], F.lit(1), F.length(x["inside"]) - 1)).otherwise(x["inside"])
        begins = reduce(lambda c, h: c | x["head"].startswith(h), REASSORTANT_HEADS[1:], x["head"].startswith(REASSORTANT_HEADS[0]))
        return F.when(begins & (x["inside"] != "") & (open_end != "") & ~open_end.contains(")"), F.concat(F.regexp_replace(open_end, r"^HY\s+", ""), F.lit(" "), x["head"])).otherwise(x["all"])

    parts = lambda x: _let(turn, all=x["all"], head=F.substring_index(x["all"], "(", 1), inside=F.substr(x["all"], F.instr(x["all"], "(") + F.when(x["all"].contains("("), 1).otherwise(F.length(x["all"]) + 1)))
    return _let(parts, all=fixed)


def cdc_id(c: Column) -> Column:
    """The 8 to 10 digits of a CDC id, or null. Behind them may stand a blank and anything, or cells that each begin with an underscore: one digit;
    or six digits, ``v`` and a digit, and maybe one digit more."""

    def said(x):
        cells = x["cells"]
        digits = lambda k, n: F.coalesce(F.get(cells, F.lit(k)), F.lit("")).rlike(rf"^\d{{{n}}}$")
        dated = digits(1, 6) & F.get(cells, F.lit(2)).rlike(r"^v\d$") & ((F.size(cells) == 3) | ((F.size(cells) == 4) & digits(3, 1)))
        tail = (F.size(cells) == 1) | (~x["blank"] & (((F.size(cells) == 2) & digits(1, 1)) | F.coalesce(dated, F.lit(False))))
        return F.when(F.length(x["number"]).between(8, 10) & (F.get(cells, F.lit(0)) == "") & tail, x["number"])

    number = F.regexp_extract(c, r"^\s*(\d+)", 1)
    behind = F.regexp_extract(c, r"^\s*\d*(\S*)", 1)
    return _let(said, number=number, cells=F.split(behind, "_", -1), blank=F.ltrim(c).rlike(r"\s"))


def fix_name(c: Column) -> Column:
    return _regexes(F.trim(c), NAME_FIXES)


def passage(c: Column) -> Column:
    return _regexes(c, PASSAGE_FIXES)


def strip_passage_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^PASSAGE-", "")


def reassortant(c: Column) -> Column:
    """``NYMC-`` and the number of one written as ``NYMC`` or not, ``X`` or ``BX``, a hyphen or not, digits and maybe a letter up to C, blanks between; others as they are."""
    behind = lambda x, *heads: F.ltrim(reduce(lambda rest, h: rest.when(x.startswith(h), F.substr(x, F.lit(len(h) + 1))), heads[1:], F.when(x.startswith(heads[0]), F.substr(x, F.lit(len(heads[0]) + 1)))))
    plain = F.ltrim(F.coalesce(behind(c, "NYMC"), c))
    number = behind(plain, "BX", "X")
    number = F.coalesce(behind(number, "-"), number)
    return F.when(number.rlike(r"^\d+[A-C]?$"), F.concat(F.lit("NYMC-"), number)).otherwise(c)


def split_reassortant(name: Column) -> Column:
    """struct(name, reassortant) of a name that may end in a reassortant: a designation and its number or letters behind the name's last number."""
    shape = rf"^(.+/\d+)\s*((?:{'|'.join(DESIGNATIONS)})[-\s]?[0-9A-Z]+)\s*$"
    hit = name.rlike(shape)
    return F.struct(F.when(hit, F.trim(F.regexp_extract(name, shape, 1))).otherwise(name).alias("name"), F.when(hit, F.trim(F.regexp_extract(name, shape, 2))).otherwise("").alias("reassortant"))


def fix_subtype(name: Column, virus_type: Column) -> Column:
    """A name that begins with ``A/`` takes the virus type; H3N0 becomes H3N2."""
    typed = F.when((F.substring(name, 1, 2) == "A/") & virus_type.startswith("A("), F.concat(virus_type, F.substr(name, F.lit(2)))).otherwise(name)
    return F.when(typed.startswith("A(H3N0)"), F.concat(F.lit("A(H3N2)"), F.substr(typed, F.lit(8)))).otherwise(typed)


def flu_code(c: Column) -> Column:
    """struct(virus_type, lineage) of H1, H3, BV.. and BY..; an error otherwise."""
    u = F.upper(c)
    kind = F.when(u == "H1", "A(H1N1)").when(u == "H3", "A(H3N2)").when(u.rlike("^B[VY]"), "B").otherwise(F.raise_error(F.concat(F.lit("Unrecognized flu: "), c)))
    return F.struct(kind.alias("virus_type"), F.when(u.startswith("BV"), "VICTORIA").when(u.startswith("BY"), "YAMAGATA").otherwise("").alias("lineage"))


def flu_selection(code: str) -> tuple[str, str]:
    """Virus type and lineage of H1, H3, BV.. and BY.. as plain strings."""
    u = code.upper()
    known = {"H1": ("A(H1N1)", ""), "H3": ("A(H3N2)", ""), "BV": ("B", "VICTORIA"), "BY": ("B", "YAMAGATA")}
    found = known.get(u if u.startswith("H") else u[:2])
    if found is None:
        raise ValueError(f"Unrecognized flu: {code}")
    return found


def date(c: Column) -> Column:
    """``YYYY[-MM[-DD]]`` in full; '' stays ''; anything else is an error."""
    shape = r"^(\d{4})-?(?:(\d\d)-?(\d\d)?)?$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, shape, k), F.lit("")), F.lit("01"))
    full = F.concat_ws("-", F.regexp_extract(c, shape, 1), part(2), part(3))
    return F.when(c.isNull() | (c == ""), "").when(c.rlike(shape), full).otherwise(F.raise_error(F.concat(F.lit("Invalid date: "), c)))


def period(text: str) -> tuple[str, str]:
    """The two ends of ``begin:end``."""
    begin, _, end = text.partition(":")
    return begin, end


def add_dates(dates: Column, more: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.concat(dates, more), lambda d: d != "")))


# ---------------------------------------------------------------- FASTA headers
# Piped headers, cell by cell (cells are trimmed):
#   name | date | passage | lab id | lab | type | lineage      seven cells, a lab of letters and a type like A / H3N2
#   name | date | passage | lab id | lab                       five cells, a lab of letters
#   name | date | passage | lab id | anything                  more than four cells and a passage
#   name | date | [passage] | [lab id]                         what is left of those with a date
#   EPI number | HA or NA | designation | EPI_ name | .. | ..  six cells
#   designation | passage | EPI number or 201 number           three cells; the last one is the name
#   name | passage | [lab id]                                  three cells, a passage without blanks
# Without pipes: a pile-up's first word; name, date and passage apart by two blanks; a contig's number; a name that ends
# with a year, and what follows it; a name that ends in _4; a name before an underscore or the last blank.
HEADER_FIELDS = ("name", "date", "passage", "lab_id", "lab", "virus_type", "lineage", "gene")


def _none() -> Column:
    return F.lit("")


def _fields(**known: Column) -> Column:
    return F.struct(*(F.coalesce(known.get(f, _none()), _none()).alias(f) for f in HEADER_FIELDS))


def _cell_date(cell: Column) -> Column:
    """A whole date, one without day or one without month and day, filled up with 01; null for anything else."""
    numbers = F.split(F.substring_index(cell, "(", 1), "-")
    n = F.when(cell.rlike(r"^\d+-\d+-\d+$"), 3).when(cell.rlike(r"(?i)^\d+-\d+\s+\(day unknown\)$"), 2).when(cell.rlike(r"(?i)^\d+\s+\(month and day unknown\)$"), 1)
    part = lambda k: F.coalesce(F.trim(F.get(numbers, F.lit(k))), F.lit("01"))
    return F.when(n.isNotNull(), F.concat_ws("-", part(0), part(1), part(2)))


def _from_cells(cells: Column, lab: Column) -> Column:
    """The fields of a piped header; null if its cells make none of the known rows."""
    n, cell = F.size(cells), lambda k: F.coalesce(F.get(cells, F.lit(k)), _none())
    letters = cell(4).rlike("^[A-Za-z ]+$")
    typed = (n == 7) & letters & cell(5).rlike(r"(?i)^[AB]\s*/\s*H\d+N\d+$") & cell(6).rlike("^[A-Za-z0-9]*$")

    def made(x):
        day, where, own_lab = x["day"], x["lab"], x["typed"] | x["own_lab"]
        id_of = lambda c: F.when(where == "CDC", cdc_id(c)).otherwise(c)
        rest = F.trim(F.array_join(F.slice(cells, F.lit(4), F.greatest(F.lit(0), n - 3)), " | "))
        whole = own_lab | ((n > 4) & (cell(2) != ""))  # the fourth cell alone is the id
        kind, lineage = F.when(x["typed"], header_type(F.upper(cell(5)))), F.when(x["typed"], fix_lineage(cell(6)))
        dated = F.when(whole | (n >= 4), _fields(name=x["name"], date=day, passage=cell(2), lab=where, lab_id=id_of(F.when(whole, cell(3)).otherwise(rest)), virus_type=kind, lineage=lineage))
        numbered = cell(2).rlike(r"(?i)^(EPI|201)\d+$")
        return F.when(day.isNotNull(), dated).when(
            (n == 6) & cell(0).rlike(r"(?i)^EPI\d+$") & cell(1).rlike("(?i)^(HA|NA)$") & cell(3).rlike("(?i)^EPI_[A-Z_0-9]+$"), _fields(name=cell(3), gene=cell(1))
        ).when(
            (n == 3) & cell(1).rlike(r"^\S+$"), F.when(numbered, _fields(name=F.upper(cell(2)), passage=cell(1))).otherwise(_fields(name=x["name"], passage=cell(1), lab_id=id_of(cell(2)), lab=lab))
        )

    placed = lambda x: _let(made, day=x["day"], name=x["name"], typed=x["typed"], own_lab=x["own_lab"], lab=F.when(x["day"].isNotNull() & (x["typed"] | x["own_lab"]), institute(cell(4))).otherwise(lab))
    return _let(placed, day=_cell_date(cell(1)), name=header_name(cell(0)), typed=typed, own_lab=(n == 5) & letters)


def _from_words(header: Column) -> Column:
    """The fields of a header without pipes; null if it is nothing but a name."""
    year_end = r"^(.+/\d{4})([^/]*)$"
    under, blank = F.instr(header, "_"), F.length(header) - F.length(F.regexp_extract(header, r"(\S*)$", 1))

    def made(x):
        upper, columns, stem, tail, cut = x["upper"], x["columns"], x["stem"], x["tail"], x["cut"]
        plain_stem = (stem != "") & ~stem.contains("_")
        ending = F.regexp_replace(tail, r"^[\s\-]+", "")
        return (
            F.when(header.rlike(r"(?i)^\S+\s+PileUp\sof"), _fields(name=F.regexp_extract(upper, r"^(\S+)", 1)))
            .when((F.size(columns) == 3) & F.get(columns, F.lit(0)).rlike(r"^\S+$") & F.get(columns, F.lit(1)).rlike(r"^[\d/]+$"), _fields(name=F.upper(F.get(columns, F.lit(0))), date=F.get(columns, F.lit(1)), passage=F.get(columns, F.lit(2))))
            .when(header.rlike(r'(?i)^\d+S\d+ +"Contig +\d+" +\(\d+,\d+\)$'), _fields(name=F.substring_index(upper, " ", 1)))
            .when(plain_stem & tail.rlike(r"^[\s_].*:[EC]"), _fields(name=stem, passage=F.regexp_extract(tail, r".*:([EC]\d*)", 1)))
            .when(plain_stem & tail.rlike(r"^[\s_]"), _fields(name=stem))
            .when(header.rlike(r"^\S+_4$"), _fields(name=upper))
            .when((cut > 1) & ~F.substr(header, cut).contains("/"), _fields(name=F.trim(F.substr(upper, F.lit(1), cut - 1))))
            .when((stem != "") & ending.rlike(r"^[.\dA-Z]*$"), _fields(name=stem, passage=ending))
        )

    upper = F.upper(header)
    return _let(made, upper=upper, columns=F.split(header, r"\s\s+"), stem=F.regexp_extract(upper, year_end, 1), tail=F.regexp_extract(upper, year_end, 2), cut=F.when(under > 1, under).otherwise(blank))


def parse_header(header: Column, lab: Column | None = None) -> Column:
    """struct of HEADER_FIELDS of a header; one of an unknown form is the name."""
    lab = F.coalesce(lab, _none()) if lab is not None else _none()
    made = lambda x: F.coalesce(F.when(F.size(x["cells"]) > 1, _from_cells(x["cells"], x["lab"])).otherwise(_from_words(x["header"])), _fields(name=x["header"]))
    return _let(made, header=header, lab=lab, cells=F.transform(F.split(header, r"\|", -1), lambda c: F.trim(c)))
