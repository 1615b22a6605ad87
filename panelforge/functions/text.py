"""Column functions that bring the spellings of identifiers together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without outer blanks, tabs and line ends included."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def panel(c: Column) -> Column:
    """Panel name: case and outer blanks do not matter; blank is null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def chromosome(c: Column) -> Column:
    """Chromosome without prefix and leading zeros, upper case; X is 23; blank is null.  ``0`` (unmapped) is null."""
    bare = F.regexp_replace(F.upper(strip(c)), r"^(CHROMOSOME|CHROM|CHR)?[\s_]*0*", "")
    return F.nullif(F.when(bare == "X", F.lit("23")).otherwise(bare), F.lit(""))


def gene_chromosome(c: Column) -> Column:
    """Chromosome of a gene map: without prefix and leading zeros, otherwise as written (upper case)."""
    return F.nullif(F.regexp_replace(F.upper(strip(c)), r"^(CHR)?0*", ""), F.lit(""))


def id_tokens(c: Column) -> Column:
    """The ids of a comma-separated list, lower case, without outer blanks; blank ones left out."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.lower(strip(x))), lambda x: x != "")


def key_space(c: Column) -> Column:
    """The part of a text key before its number; with ``key_number`` it gives the text back exactly.

    The number is the longest ending of at most 18 digits without a leading zero (or a single 0).
    """
    return F.regexp_replace(c, r"(0|[1-9][0-9]{0,17})$", "")


def key_number(c: Column) -> Column:
    """The number a text key ends with, -1 where it ends with none."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(0|[1-9][0-9]{0,17})$", 1), F.lit("")).cast("long"), F.lit(-1).cast("long"))


NUMBER = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def decimal_number(c: Column) -> Column:
    """A finite decimal number (sign, point, exponent, outer blanks allowed) as double; anything else is null."""
    t = strip(c)
    d = F.when(t.rlike(f"^{NUMBER}$"), t).try_cast("double")
    return F.when(F.abs(d) < float("inf"), d)
