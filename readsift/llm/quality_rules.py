"""Host-level quality rules with an empirical beta prior (operator 2, DataFrame functions only).

``document_rules`` measures each document by itself. ``host_verdicts`` counts how many documents
of each host break each rule, estimates one beta prior a rule from all hosts by the method of
moments, shrinks each host's failure rate towards it, and condemns hosts whose shrunk rate is at
least ``max_rate``. ``apply`` joins the verdicts back.

Defined results: a null text counts as a text without words (base_failed, n_words 0); a null host
is a host of its own; repeated rows are counted and returned each; an empty table gives an empty
result; columns beside id, text and host are ignored, so their names cannot clash. One host may
hold any share of the rows: rates use map-side partial sums and the join back is salted.

Window keys are 64-bit hashes compared inside one document only (for 20,000 words the chance of
one false match is about 1e-11).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, even_lookup, let, materialise, table


@dataclass(frozen=True)
class HostRules:
    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 10
    max_dup_line_pct: int = 50
    #: A host goes when the shrunk share of its failing documents reaches this for any rule.
    max_rate: float = 0.5
    window: int = 8


RULES = ("short", "repeats", "symbols", "dup_lines")


def _pairs(a: Column, step: int, n: int) -> Column:
    """Hash of each element with the one ``step`` later; empty where there is none."""
    size = F.greatest(F.size(a) - F.lit(step), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), size), F.slice(a, F.lit(1 + step), size), lambda x, y: F.xxhash64(x, y))


def _covered(h: Column, window: int) -> Column:
    """Words covered by the windows whose hash occurs twice or more, by one sort of (hash, start)."""

    def of_sorted(s: Column) -> Column:
        last = F.size(s) - 1
        dup = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == s[k]["h"])),
        )
        return let(F.array_sort(F.transform(dup, lambda k: s[k]["i"])), of_starts)

    def of_starts(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(F.lit(window), b - a))
        return F.lit(window) + F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)


def document_rules(docs: DataFrame, text: str = "text", rules: HostRules = HostRules()) -> DataFrame:
    """Add word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words and base_failed to every row."""
    if rules.window != 8:
        raise ValueError("windows are hashed by three doublings: 8 words")
    t = F.coalesce(F.col(text), F.lit(""))
    d = materialise(docs, __w=F.filter(F.split(t, SPACE), lambda x: x != ""))
    d = materialise(d, __h=F.transform("__w", lambda x: F.xxhash64(x)))
    for step in (1, 2, 4):
        d = materialise(d.withColumnRenamed("__h", "__g"), __h=_pairs(F.col("__g"), step, rules.window)).drop("__g")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": F.when(F.instr(t, "\n") > 0, let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))).otherwise(0).cast("long"),
            "n_lines": (F.length(t) - F.length(F.translate(t, "\n", "")) + 1).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct("__h")) == F.size("__h"), 0).otherwise(_covered(F.col("__h"), rules.window)).cast("long"),
        }
    ).drop("__w", "__h")
    return d.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words")))


def rule_failures(d: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """One boolean a rule (fail_<rule>) from the measures of ``document_rules``."""
    return d.withColumns(
        {
            "fail_short": F.col("n_words") < rules.min_words,
            "fail_repeats": 100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"),
            "fail_symbols": 100 * F.col("n_symbols") > rules.max_symbol_pct * F.col("word_chars"),
            "fail_dup_lines": 100 * F.col("n_dup_lines") > rules.max_dup_line_pct * F.col("n_lines"),
        }
    )


def beta_prior(n_hosts: str, mean: str, var: str, inv_n: str) -> tuple[Column, Column]:
    """Alpha and beta by moments: the variance between hosts less the binomial part of it.

    strength = m(1-m)/v - 1, held between 1 and 1e6; with no spread left the prior is strongest.
    """
    m, v = F.col(mean), F.col(var) - F.col(mean) * (1 - F.col(mean)) * F.col(inv_n)
    strength = F.when(v <= 0, F.lit(1e6)).otherwise(F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(1e6)))
    return m * strength, (1 - m) * strength


def host_verdicts(d: DataFrame, host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """host, n_docs, rate_<rule> (shrunk) and host_kept, one row a host."""
    per = d.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"k_{r}") for r in RULES])
    share = [(F.col(f"k_{r}") / F.col("n_docs")) for r in RULES]
    prior = per.agg(
        F.avg(1 / F.col("n_docs")).alias("inv_n"),
        *[x for r, s in zip(RULES, share) for x in (F.avg(s).alias(f"m_{r}"), F.var_pop(s).alias(f"v_{r}"))],
    )
    out = per.crossJoin(F.broadcast(prior))  # one row
    kept = F.lit(True)
    for r in RULES:
        a, b = beta_prior("n_docs", f"m_{r}", f"v_{r}", "inv_n")
        out = out.withColumn(f"rate_{r}", F.round((F.col(f"k_{r}") + a) / (F.col("n_docs") + a + b), 9))
        kept = kept & (F.col(f"rate_{r}") < rules.max_rate)
    return out.withColumn("host_kept", kept).select(host, "n_docs", *[f"rate_{r}" for r in RULES], "host_kept")


def apply(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """Measures, failures and verdict for each document; ``kept`` is false if base_failed, else the host's verdict."""
    d = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))
    d = rule_failures(document_rules(d, "text", rules), rules).drop("text")
    d = cut(d, "rules")  # measured once, read twice
    out = even_lookup(d, cut(host_verdicts(d, "host", rules), "hosts"), "host")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", *[f"rate_{r}" for r in RULES], "host_kept"
    )


def _sql() -> str:
    ws = r"[^\x20\x09-\x0D]+"
    rates = ",\n".join(
        f"round((k_{r} + m_{r} * s_{r}) / (n_docs + m_{r} * s_{r} + (1 - m_{r}) * s_{r}), 9) AS rate_{r}" for r in RULES
    )
    strengths = ", ".join(
        f"CASE WHEN v_{r} - m_{r} * (1 - m_{r}) * inv_n <= 0 THEN 1e6::DOUBLE ELSE least(greatest(m_{r} * (1 - m_{r}) / (v_{r} - m_{r} * (1 - m_{r}) * inv_n) - 1, 1.0::DOUBLE), 1e6::DOUBLE) END AS s_{r}"
        for r in RULES
    )
    moments = ", ".join(f"avg(k_{r} / n_docs::DOUBLE) AS m_{r}, var_pop(k_{r} / n_docs::DOUBLE) AS v_{r}" for r in RULES)
    return f"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, row_number() OVER () AS rid,
         regexp_extract_all(coalesce(text, ''), '{ws}') AS w
  FROM documents),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] || ' ' || w[i+5] || ' ' || w[i+6] || ' ' || w[i+7] AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM hit) GROUP BY rid),
m AS (
  SELECT d.doc_id, d.host, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         len(string_split(t, chr(10)))::BIGINT AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln FROM d) d LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words < 20 AS f_short, 100 * n_repeat_words > 30 * n_words AS f_repeats,
         100 * n_symbols > 10 * word_chars AS f_symbols, 100 * n_dup_lines > 50 * n_lines AS f_dup_lines
  FROM m),
per AS (
  SELECT host, count(*) AS n_docs, {", ".join(f"sum(f_{r}::INT)::BIGINT AS k_{r}" for r in RULES)} FROM f GROUP BY host),
pri AS (SELECT avg(1 / n_docs::DOUBLE) AS inv_n, {moments} FROM per),
ver AS (
  SELECT host, {rates} FROM (SELECT *, {strengths} FROM per, pri))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"rate_{r} < 0.5" for r in RULES)} AS kept,
       f.host AS host, {", ".join(f"rate_{r}" for r in RULES)}, {" AND ".join(f"rate_{r} < 0.5" for r in RULES)} AS host_kept
FROM f LEFT JOIN ver ON f.host IS NOT DISTINCT FROM ver.host
"""


QUERIES = {"op2_host_quality": op2_host_quality}
ORACLES = {"op2_host_quality": _sql()}
