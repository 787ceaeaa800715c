"""Scalar expressions: names, hashes, buckets, ids, entities, formats. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polymer codes that count as one token.
STANDARD_CODES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL UNK MSE A G C U DA DG DC DT N DN".split()
#: Heavy atoms of common ligand and modification codes.
ATOM_COUNTS = {
    "CA": 1, "MG": 1, "ZN": 1, "NA": 1, "CL": 1, "K": 1, "MN": 1, "FE": 1, "CU": 1, "NI": 1, "CO": 1, "BR": 1, "F": 1, "I": 1,
    "TPO": 14, "PTR": 16, "SEP": 10, "HYP": 8, "MLY": 10, "CSO": 7, "NAG": 14, "BMA": 11, "MAN": 11, "FUC": 10, "GAL": 11, "SIA": 20,
    "BTN": 16, "HEM": 43, "NAD": 44, "ATP": 31, "GTP": 32, "FAD": 53,
}
UNKNOWN_ATOMS = 20
#: Names that no job may take: folders, and the one that holds the engine's own state.
RESERVED_IDS = (".", "..", "_jobloom")
#: Spellings of booleans.
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")


def sanitise(name: Column) -> Column:
    """Spaces become underscores; only ``[A-Za-z0-9_.-]`` stays."""
    return F.regexp_replace(F.translate(name, " ", "_"), "[^A-Za-z0-9_.-]", "")


def usable_id(job_id: Column) -> Column:
    return (job_id != "") & ~F.lower(job_id).isin(*RESERVED_IDS)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def short_hash(text: Column) -> Column:
    """First 16 hexadecimal digits, as used for configurations."""
    return F.substring(F.sha2(text, 256), 1, 16)


def snap_up(n: Column, ladder: Column) -> Column:
    """The first rung of a sorted array that is at least ``n``; null above the ladder."""
    return F.try_element_at(F.filter(ladder, lambda b: b >= n), F.lit(1))


def bucket_for(n: Column, ladder: Column) -> Column:
    """The next rung, or ``n`` itself above the ladder; a negative size is an error."""
    return F.when(n < 0, F.raise_error(F.lit("size must not be negative")).cast("bigint")).otherwise(F.coalesce(snap_up(n, ladder), n))


def near_boundary(n: Column, ladder: Column, margin: float) -> Column:
    """Whether ``n`` lies within ``margin`` of the next rung from below."""
    b = F.coalesce(snap_up(n, ladder), n)
    return (b > n) & (b - n <= F.greatest(F.floor(b * F.lit(margin)), F.lit(1)))


def ceil_multiple(n: Column, k: int) -> Column:
    """``n`` rounded up to a multiple of ``k``; 0 for ``n <= 0``."""
    return F.when(n <= 0, F.lit(0).cast("bigint")).otherwise(F.ceil(n / k) * k)


def base26(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA and so on, up to six letters; null for ``n <= 0``."""
    out, rest = F.lit(""), n.cast("bigint")
    for _ in range(6):
        letter = F.char(F.lit(65) + (rest - 1) % 26)
        out = F.when(rest > 0, F.concat(letter, out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(rest)
    return F.when(n > 0, out)


def free_ids(used: Column, n: Column) -> Column:
    """The next ``n`` ids, in order, that are not among ``used``."""
    ids = F.transform(F.sequence(F.lit(1), F.size(used) + n), lambda i: base26(i))
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.slice(F.array_except(ids, used), F.lit(1), n))


def copies(ids: Column) -> Column:
    """How often an entity stands: the number of its ids, at least 1."""
    return F.coalesce(F.greatest(F.size(ids), F.lit(1)), F.lit(1))


def modification_extra(codes: Column) -> Column:
    """(extra tokens, exact) of an array of modification codes."""
    atoms = F.create_map(*(F.lit(x) for kv in ATOM_COUNTS.items() for x in kv))
    other = F.filter(codes, lambda c: (c != "") & ~c.isin(*STANDARD_CODES))
    extra = F.aggregate(other, F.lit(0), lambda n, c: n + F.greatest(F.coalesce(F.try_element_at(atoms, c), F.lit(UNKNOWN_ATOMS)) - 1, F.lit(0)))
    exact = F.forall(other, lambda c: F.try_element_at(atoms, c).isNotNull())
    return F.struct(F.coalesce(extra, F.lit(0)).alias("extra"), F.coalesce(exact, F.lit(True)).alias("exact"))


def gaps(flags: Column) -> Column:
    """For each kept position of a boolean array, how many dropped ones stand before it since the last kept one."""
    at = F.filter(F.transform(flags, lambda f, i: F.when(f, i).otherwise(-1)), lambda i: i >= 0)
    return F.transform(at, lambda p, i: p - F.when(i > 0, F.try_element_at(at, i)).otherwise(-1) - 1)


def padded_len(*arrays: Column) -> Column:
    """Size of the first array that is there, else -1."""
    return F.coalesce(*(F.when(a.isNotNull(), F.size(a)) for a in arrays), F.lit(-1))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def bar(done: Column, total: Column, width: int = 20) -> Column:
    """An ASCII progress bar."""
    filled = F.when(total > 0, F.floor(done * width / total)).otherwise(0).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled), F.lit("]"))


def parse_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def exit_code(code: Column) -> Column:
    """A signal's negative code as a shell reports it."""
    return F.when(code < 0, F.lit(128) - code).otherwise(code)


def batch_sizes(n: Column) -> Column:
    """Distinct moves of a type: one, a half, all, a quarter, three quarters."""
    sizes = F.array(F.lit(1).cast("bigint"), F.floor(n / 2), n.cast("bigint"), F.floor(n / 4), F.floor(n * 3 / 4))
    return F.array_distinct(F.filter(sizes, lambda x: x > 0))


#: What the driver's context needs, and the share that is taken where that cannot be spared.
RESERVED_BYTES, SMALL_MEMORY_FRACTION = 640 << 20, 0.95


def memory_fraction(memory_bytes: Column) -> Column:
    """The share of an executor's memory to claim: all but the reserve, to four digits; a fixed share up to twice the reserve."""
    rest = F.round((memory_bytes - RESERVED_BYTES) / memory_bytes, 4)
    return F.when(memory_bytes <= 2 * RESERVED_BYTES, SMALL_MEMORY_FRACTION).otherwise(rest)
