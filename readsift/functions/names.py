"""Name normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def read_id(c: Column) -> Column:
    """The name up to the first white space."""
    return F.regexp_replace(c, r"\s.*$", "")


def contig_species(c: Column) -> Column:
    """Fallback for contigs without a lookup entry: the name up to the first ':' or '_'."""
    return F.regexp_replace(c, r"[:_].*$", "")


def canonical_species(stem: Column) -> Column:
    """File stem to the species name used by the abundance table (fixed values: two spelling repairs)."""
    s = F.regexp_replace(stem, "^Escherichia_coli_b", "Escherichia_coli_B")
    return F.when(s == "Candida_albican", "Candida_albicans").otherwise(s)


def species_group(species: Column) -> Column:
    """Strains of one species that reads cannot tell apart fold into it (fixed value: one species)."""
    return F.regexp_replace(species, "^Escherichia_coli_.*$", "Escherichia_coli")


def unblock_flag(c: Column) -> Column:
    """1 where the end reason mentions unblocking, in any case; a null reason gives 0."""
    return F.coalesce(F.lower(c).contains("unblock"), F.lit(False)).cast("int")
