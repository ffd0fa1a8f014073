"""Assembly of the read feature table from its sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import unblock_flag
from ..functions.sequence import dust_scores, gc_fraction, homopolymer_frac
from ..functions.tokens import parse_tokens, token_features
from .topk import best_per_key, margin_diversity

#: Feature blocks, arms and ablation sets are design data (fixed values).
BLOCKS = {
    "blast_core": ("qlen", "pident", "evalue", "mismatch", "aln_fraction", "query_cov", "bitscore"),
    "blast_margin": ("bitscore_margin_species", "n_species_topn", "n_genera_topn", "tax_entropy_topn"),
    "human_competitor": ("human_bitscore", "human_pident", "human_minus_best_margin"),
    "kraken2": ("k2_conf", "k2_kmers_taxon_frac", "k2_distinct_minimizers"),
    "complexity": ("dust_score", "gc", "homopolymer_frac"),
    "read_qc": ("read_len", "mean_q", "end_reason_unblock"),
}
ARMS = {
    "blast_only": ("blast_core", "blast_margin", "human_competitor", "complexity", "read_qc"),
    "kraken2_only": ("kraken2", "complexity", "read_qc"),
    "combined": ("blast_core", "blast_margin", "human_competitor", "kraken2", "complexity", "read_qc"),
}
SUBJECT_PROPERTIES = ("subject_genome_len",)
#: Columns that identify a read, a sample or a taxon and must never be features.
IDENTITY = ("read_id", "library_id", "donor", "run_id", "barcode", "titration_level", "concentration", "species", "label", "label_prefloor", "top_species", "top_genus", "k2_taxid")


def arm_features(arm: str, without: Sequence[str] = ()) -> list[str]:
    """Feature names of an arm less the blocks ``without``."""
    names = [f for b in ARMS[arm] if b not in without for f in BLOCKS[b]]
    return [*names, *SUBJECT_PROPERTIES] if "blast_core" in ARMS[arm] and "blast_core" not in without else names


def model_columns(df: DataFrame, arm: str) -> list[str]:
    """The arm's features that the table has; raises on missing, identity or non-numeric ones."""
    kinds = dict(df.dtypes)
    missing = [f for f in arm_features(arm) if f not in kinds]
    if missing:
        raise ValueError(f"features not in the table: {', '.join(missing)}")
    bad = [f for f in arm_features(arm) if f in IDENTITY or kinds[f] in ("string", "boolean", "timestamp")]
    if bad:
        raise ValueError(f"not features: {', '.join(bad)}")
    return arm_features(arm)


def blast_features(hits: DataFrame, lineage: DataFrame | None, n: int = 10, strict: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """Core features of the best hit and margin features of the top n. Unmapped taxids have no taxon.

    ``extra``, here and below, are further columns of the key, such as library_id.
    """
    if lineage is None:
        h = hits.withColumn("species", F.col("staxid")).withColumn("genus", F.col("staxid"))
    else:
        h = hits.join(lineage.select(F.col("taxid").cast("string").alias("staxid"), "species", "genus"), "staxid", "left")
    core = best_per_key(h, ["qseqid", *extra], "bitscore", ["_ord"]).select(
        "qseqid", *extra, "qlen", "pident", "evalue", "mismatch", "aln_fraction", "query_cov", "bitscore", F.col("genus").alias("top_genus"), F.col("slen").alias("subject_genome_len")
    )
    margin = margin_diversity(h, ["qseqid", *extra], "bitscore", "species", "genus", ["_ord"], n, strict)
    return core.join(margin, ["qseqid", *extra], "full_outer").withColumnRenamed("qseqid", "read_id")


def competitor_features(paf: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    best = best_per_key(paf, ["qname", *extra], "score", ["_ord"])
    return best.select(F.col("qname").alias("read_id"), *extra, F.col("score").alias("human_bitscore"), F.col("identity").alias("human_pident"))


def kraken_features(k: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    d = k.withColumn("__t", parse_tokens(F.col("kmer_lca")))
    return d.select("read_id", *extra, *[c.alias(n) for n, c in token_features(F.col("__t"), F.col("k2_taxid")).items()])


def qc_features(qc: DataFrame, end_reasons: DataFrame | None = None, sequences: DataFrame | None = None, keys: Sequence[str] = ("read_id",)) -> DataFrame:
    """Read statistics with the unblock flag and the complexity of the sequences (keys, sequence).

    Reads are those of ``qc``. A read without an end reason was not unblocked (0); without the table
    the flag is null. gc comes from the sequences only where ``qc`` has no such column; without
    sequences dust_score and homopolymer_frac are null.
    """
    none = F.lit(None).cast("double")
    out = qc
    if end_reasons is None:
        out = out.withColumn("end_reason_unblock", F.lit(None).cast("int"))
    else:
        out = out.join(end_reasons.select(*keys, "end_reason"), list(keys), "left")
        out = out.withColumn("end_reason_unblock", unblock_flag(F.col("end_reason")))
    if sequences is None:
        return out.withColumns({c: none for c in ("dust_score", "homopolymer_frac", *(() if "gc" in qc.columns else ("gc",)))})
    s = sequences.select(F.struct(*keys).alias("__k"), "sequence")
    base = s.select("__k", homopolymer_frac(F.col("sequence")).alias("homopolymer_frac"), *(() if "gc" in qc.columns else (gc_fraction(F.col("sequence")).alias("gc"),)))
    found = base.join(dust_scores(s, "__k", "sequence"), "__k").select("__k.*", *base.columns[1:], "dust_score")
    return out.join(found, list(keys), "left")


def outer_union(sources: Sequence[DataFrame], key: str | Sequence[str] = "read_id") -> DataFrame:
    """Full outer join of sources that have the key once each.

    Done as a union and one aggregation, one shuffle however many sources there are.
    """
    keys = [key] if isinstance(key, str) else [*key]
    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return d.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in d.columns if c not in keys])


def feature_table(labels: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str] = ("read_id",)) -> DataFrame:
    """Labels with all features; human_minus_best_margin is null if either score is."""
    f = outer_union(sources, keys)
    out = labels.join(f, list(keys), "left")
    if {"human_bitscore", "bitscore"} <= set(out.columns):
        out = out.withColumn("human_minus_best_margin", F.col("human_bitscore") - F.col("bitscore"))
    return out
