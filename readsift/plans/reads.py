"""Queries on reads: best hits, labels, detectability, intervals, sequence functions, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, sequence, tokens
from ..operators import cutoffs, features, intervals, labels, library, topk
from ..session import spread, table
from .bridge import CELLS, HITS_SQL, LEVELS, TIES, labels_sql, line_hits
from .bridge import labels as order_labels

R = lambda c, k=6: F.round(c, k)
QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS score FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) = 1""")
def best_hit_per_key(spark, d):
    best = topk.best_per_key(table(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", ["l_linenumber", "l_partkey", "l_suppkey"])
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("score"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS score, rk AS hit_rank
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)::INT AS rk FROM lineitem) WHERE rk <= 10""")
def topn_per_key(spark, d):
    t = topk.top_n(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"], 10)
    return t.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("score"), "hit_rank")


@query("""WITH h AS (
  SELECT l_orderkey, l_extendedprice AS v, CASE WHEN p_size < 48 THEN p_brand END AS s, p_type AS g,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rk
  FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT *, first_value(s) OVER (PARTITION BY l_orderkey ORDER BY rk) AS s1, first_value(v) OVER (PARTITION BY l_orderkey ORDER BY rk) AS v1 FROM h WHERE rk <= 5),
c AS (SELECT l_orderkey, s, count(*) AS c FROM t WHERE s IS NOT NULL GROUP BY ALL),
e AS (SELECT l_orderkey, -sum(c / n::DOUBLE * log2(c / n::DOUBLE)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY l_orderkey) AS n FROM c) GROUP BY 1)
SELECT l_orderkey, min(s1) AS top_species,
       round(CASE WHEN count(*) = count(s) THEN max(v1) - coalesce(max(v) FILTER (s <> s1), 0) END, 6) AS bitscore_margin_species,
       (count(DISTINCT s) + max((s IS NULL)::INT))::BIGINT AS n_species_topn, count(DISTINCT g) AS n_genera_topn,
       round(abs(coalesce(min(h), 0)), 6) AS tax_entropy_topn
FROM t LEFT JOIN e USING (l_orderkey) GROUP BY l_orderkey""")
def topn_margin_diversity(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 48, F.col("p_brand")).alias("species"), F.col("p_type").alias("genus"))
    h = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    m = topk.margin_diversity(h, "l_orderkey", "l_extendedprice", "species", "genus", ["l_linenumber", "l_partkey", "l_suppkey"], 5)
    return m.withColumns({"bitscore_margin_species": R("bitscore_margin_species"), "tax_entropy_topn": R("tax_entropy_topn")})


@query(f"""WITH {HITS_SQL},
h AS (SELECT read_id, max(score) AS host_score FROM hits WHERE reference IN ('A', 'R') GROUP BY 1),
t AS (SELECT read_id, max(score) AS target_score FROM hits WHERE reference = 'N' GROUP BY 1)
SELECT read_id, host_score, coalesce(target_score, 0) AS target_score FROM h LEFT JOIN t USING (read_id) WHERE host_score > coalesce(target_score, 0)""")
def competition_depletion(spark, d):
    h = line_hits(spark, d)
    return labels.depleted([h.where("reference = 'A'"), h.where("reference = 'R'")], h.where("reference = 'N'"))


@query(f"""WITH {HITS_SQL},
gone AS (SELECT read_id FROM hits GROUP BY 1 HAVING max(score) FILTER (reference <> 'N') > coalesce(max(score) FILTER (reference = 'N'), 0))
SELECT o_orderkey AS read_id, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT read_id FROM gone)""")
def depletion_survivors(spark, d):
    reads = table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), "o_custkey")
    return labels.survivors(reads, competition_depletion(spark, d))


@query(f"WITH {HITS_SQL}, {labels_sql()} SELECT read_id, round(identity, 6) AS identity, round(coverage, 6) AS coverage, target, host, label FROM lab")
def three_class_label(spark, d):
    return order_labels(spark, d).select("read_id", R("identity").alias("identity"), R("coverage").alias("coverage"), "target", "host", "label")


@query("""WITH a AS (
  SELECT 'o' || l_orderkey AS read_id, l_returnflag AS reference, 1 - l_discount AS identity, l_quantity / 50.0::DOUBLE AS coverage, l_extendedprice AS score,
         'c' || (l_partkey % 20) || '_' || (l_suppkey % 3) AS tname, l_partkey % 1000 AS tstart, l_partkey % 1000 + l_quantity::BIGINT AS tend,
         l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount FROM lineitem),
b AS (SELECT * FROM a WHERE reference = 'N' QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) = 1),
h AS (SELECT read_id, max(score) AS human_score FROM a WHERE reference <> 'N' GROUP BY 1),
m AS (SELECT 'c' || (s_suppkey % 20) || '_' || (s_suppkey % 3) AS tname, s_suppkey * 7 % 1000 AS s, s_suppkey * 7 % 1000 + 2 AS e FROM supplier),
r AS (SELECT read_id FROM b WHERE EXISTS (SELECT 1 FROM m WHERE m.tname = b.tname AND tstart <= e AND tend >= s))
SELECT 'o' || o_orderkey AS read_id, coalesce(score, 0) AS zymo_score, coalesce(human_score, 0) AS human_score, split_part(tname, '_', 1) AS species,
       CASE WHEN r.read_id IS NOT NULL THEN 'ambiguous'
            WHEN identity >= 0.93::DOUBLE AND coverage >= 0.5::DOUBLE AND score > coalesce(human_score, 0) THEN 'positive' ELSE 'negative' END AS label
FROM orders LEFT JOIN b ON 'o' || o_orderkey = b.read_id LEFT JOIN h ON 'o' || o_orderkey = h.read_id LEFT JOIN r ON 'o' || o_orderkey = r.read_id""")
def library_labels(spark, d):
    contig = lambda a, b: F.concat(F.lit("c"), F.col(a) % 20, F.lit("_"), F.col(b) % 3)
    a = table(spark, d, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey", F.lit(" tail")).alias("qname"), F.col("l_returnflag").alias("reference"), (1 - F.col("l_discount")).alias("identity"),
        (F.col("l_quantity") / 50.0).alias("coverage"), F.col("l_extendedprice").alias("score"), contig("l_partkey", "l_suppkey").alias("tname"),
        (F.col("l_partkey") % 1000).alias("tstart"), (F.col("l_partkey") % 1000 + F.col("l_quantity").cast("long")).alias("tend"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount").alias("_ord"),
    )
    at = F.col("s_suppkey") * 7 % 1000
    regions = table(spark, d, "supplier").select(contig("s_suppkey", "s_suppkey").alias("tname"), at.alias("start"), (at + 2).alias("end"))
    reads = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("read_id"))
    of = lambda x: a.where(F.col("reference") == x)
    out = library.label_library(of("N"), [of("A"), of("R")], reads, regions, min_identity=0.93, min_coverage=0.5)
    return out.select("read_id", "zymo_score", "human_score", "species", "label")


_FLOOR = f"""{HITS_SQL}, {labels_sql()},
ab AS (SELECT p_brand AS species, count(*) / (SELECT count(*) FROM part)::DOUBLE / 1e6::DOUBLE AS rel_abundance FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1),
cells(o_orderpriority, titration_level, concentration) AS (VALUES {", ".join(f"('{p}', '{l}', {CELLS[l]}::DOUBLE)" for p, l in LEVELS.items())}),
sp AS (SELECT lab.*, p_brand AS species, titration_level, concentration FROM lab LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN cells USING (o_orderpriority)),
fl AS (SELECT sp.*, concentration * rel_abundance AS expected_cells, 1 - exp(-concentration * rel_abundance) AS p_detect FROM sp LEFT JOIN ab USING (species)),
floored AS (
  SELECT *, coalesce(p_detect < 0.95, false) AS indeterminate, label AS label_prefloor,
         CASE WHEN label = 'positive' AND coalesce(p_detect < 0.95, false) THEN 'indeterminate' ELSE label END AS label_floor FROM fl)"""


def _abundance(spark, d):
    p = table(spark, d, "part")
    n = p.count()
    return p.where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("species")).agg((F.count(F.lit(1)) / float(n) / 1e6).alias("rel_abundance"))


def _level():
    return F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("o_orderpriority")]


def floored_labels(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("species"))
    lab = order_labels(spark, d).join(p, "l_partkey", "left").withColumn("titration_level", _level()).withColumn("concentration", F.lit(None).cast("double"))
    return labels.apply_poisson_floor(lab, _abundance(spark, d), cells_per_level=CELLS)


@query(f"WITH {_FLOOR} SELECT read_id, species, titration_level, round(expected_cells, 9) AS expected_cells, round(p_detect, 9) AS p_detect, indeterminate, label_prefloor, label_floor AS label FROM floored")
def poisson_floor(spark, d):
    f = floored_labels(spark, d)
    return f.select("read_id", "species", "titration_level", R("expected_cells", 9).alias("expected_cells"), R("p_detect", 9).alias("p_detect"), "indeterminate", "label_prefloor", "label")


_GRID = f"""ab AS (SELECT p_brand AS species, count(*) / (SELECT count(*) FROM part)::DOUBLE / 1e6::DOUBLE AS rel_abundance FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1),
cells(titration_level, concentration) AS (VALUES {", ".join(f"('{l}', {c}::DOUBLE)" for l, c in CELLS.items())}),
grid AS (SELECT n_name || '-' || titration_level AS library_id, n_name AS donor, titration_level, concentration, species, rel_abundance, concentration * rel_abundance AS expected_cells, 1 - exp(-concentration * rel_abundance) AS p_detect FROM nation, cells, ab)"""


def _libraries(spark, d):
    cells = spark.createDataFrame(list(CELLS.items()), "titration_level string, concentration double")
    n = table(spark, d, "nation").select(F.col("n_name").alias("donor"))
    return n.crossJoin(cells).withColumn("library_id", F.concat_ws("-", "donor", "titration_level"))


def expected_samples(spark, d):
    return labels.expected_grid(_libraries(spark, d), _abundance(spark, d))


@query(f"WITH {_GRID} SELECT library_id, donor, titration_level, species, round(expected_cells, 9) AS expected_cells, round(p_detect, 9) AS p_detect, p_detect >= 0.95 AS expected_present FROM grid")
def expected_grid(spark, d):
    g = expected_samples(spark, d)
    return g.select("library_id", "donor", "titration_level", "species", R("expected_cells", 9).alias("expected_cells"), R("p_detect", 9).alias("p_detect"), "expected_present")


@query(f"WITH {_GRID}, k AS (SELECT DISTINCT titration_level, species, expected_cells, p_detect FROM grid) SELECT titration_level, species, round(expected_cells, 9) AS expected_genomes, round(p_detect, 9) AS p_detect, coalesce(p_detect < 0.95, true) AS indeterminate FROM k")
def floor_grid(spark, d):
    lv = spark.createDataFrame(list(CELLS.items()), "titration_level string, total_cells double")
    g = labels.floor_grid(lv, _abundance(spark, d))
    return g.select("titration_level", "species", R("expected_genomes", 9).alias("expected_genomes"), R("p_detect", 9).alias("p_detect"), "indeterminate")


@query(f"""WITH {_FLOOR}, x AS (SELECT c_nationkey AS run_id, titration_level, label_prefloor FROM floored JOIN customer ON o_custkey = c_custkey)
SELECT run_id, count(*) FILTER (titration_level = 'c5') AS negative_reads, count(*) FILTER (titration_level = 'c5' AND label_prefloor = 'negative') AS negative_background,
       count(*) FILTER (titration_level = 'c5' AND label_prefloor = 'positive') AS negative_positive,
       round(count(*) FILTER (titration_level = 'c5' AND label_prefloor = 'positive') / nullif(count(*) FILTER (titration_level = 'c5'), 0)::DOUBLE, 6) AS leakage_upper_bound,
       round(count(*) FILTER (titration_level = 'c5' AND label_prefloor = 'positive') / nullif(count(*) FILTER (label_prefloor = 'positive'), 0)::DOUBLE, 6) AS leakage_vs_positive_pool
FROM x GROUP BY run_id""")
def leakage_diagnostic(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("run_id"))
    x = labels.leakage(floored_labels(spark, d).join(c, "o_custkey"), control="c5")
    return x.withColumns({k: R(k) for k in ("leakage_upper_bound", "leakage_vs_positive_pool")})


def _errors(spark, d):
    """Event intervals of each user, in seconds of the month."""
    e = table(spark, d, "events")
    at = F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200
    return e.select("event_id", "user_id", "event_type", at.alias("start"), (at + F.floor(F.col("value") * 60)).alias("end"))


_EV = """ev AS (SELECT event_id, user_id, event_type, epoch(date_trunc('second', ts))::BIGINT - 1704067200 AS start, epoch(date_trunc('second', ts))::BIGINT - 1704067200 + floor(value * 60)::BIGINT AS "end" FROM events),
err AS (SELECT * FROM ev WHERE event_type = 'error' AND "end" >= start),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM err)),
mi AS (SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS n_merged FROM isl GROUP BY user_id, island)"""


@query(f'WITH {_EV} SELECT user_id, start, "end", n_merged FROM mi')
def merge_intervals(spark, d):
    return intervals.merge_intervals(_errors(spark, d).where("event_type = 'error' and end >= start"), ["user_id"])


@query(f'WITH {_EV} SELECT event_id, EXISTS (SELECT 1 FROM mi WHERE mi.user_id = ev.user_id AND ev.start <= mi."end" AND ev."end" >= mi.start) AS in_region FROM ev')
def interval_overlap_flag(spark, d):
    e = _errors(spark, d)
    return intervals.overlap_flag(e, merge_intervals(spark, d), "user_id", ids=["event_id"]).select("event_id", "in_region")


@query(ORACLES["interval_overlap_flag"])
def interval_overlap_binned(spark, d):
    e = _errors(spark, d)
    return intervals.overlap_flag(e, merge_intervals(spark, d), "user_id", ids=["event_id"], bin_size=21600).select("event_id", "in_region")


@query(ORACLES["interval_overlap_flag"])
def interval_overlap_sweep(spark, d):
    e = _errors(spark, d)
    return intervals.overlap_sweep(e, merge_intervals(spark, d), "user_id").select("event_id", "in_region")


_COV = f"""WITH {_EV},
c AS (SELECT user_id, least(2592000, greatest(0, start))::DOUBLE AS s, least(2592000, greatest(0, "end"))::DOUBLE AS e FROM ev),
o AS (SELECT * FROM c WHERE e > s),
x AS (SELECT user_id, s AS pos, 1 AS d FROM o UNION ALL SELECT user_id, e, -1 FROM o UNION ALL SELECT DISTINCT user_id, 0, 0 FROM o),
g AS (SELECT user_id, pos, sum(d) AS d FROM x GROUP BY ALL),
seg AS (SELECT user_id, sum(d) OVER w AS depth, coalesce(lead(pos) OVER (PARTITION BY user_id ORDER BY pos), 2592000) - pos AS len FROM g WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT user_id, depth, sum(len) AS len FROM seg WHERE len > 0 GROUP BY ALL),
ar AS (SELECT *, len * (2 * sum(depth * len) OVER (PARTITION BY user_id ORDER BY depth ROWS UNBOUNDED PRECEDING) - depth * len) / 2 AS area FROM lv),
st AS (SELECT user_id, sum(len) FILTER (depth > 0) / 2592000 AS genome_breadth, greatest(0, least(1, 1 - 2 * sum(area) / (2592000 * sum(depth * len)))) AS gini FROM ar GROUP BY 1)"""


@query(_COV + " SELECT user_id, round(coalesce(genome_breadth, 0), 6) AS genome_breadth, round(coalesce(1 - gini, 0), 6) AS coverage_evenness FROM (SELECT DISTINCT user_id FROM ev) LEFT JOIN st USING (user_id)")
def coverage_breadth_evenness(spark, d):
    c = intervals.coverage(_errors(spark, d).withColumn("glen", F.lit(2592000.0)), ["user_id"])
    return c.select("user_id", R("genome_breadth").alias("genome_breadth"), R("coverage_evenness").alias("coverage_evenness"))


@query(_COV + """, f AS (SELECT user_id % 10 AS species, user_id, coalesce(genome_breadth, 0) AS b, coalesce(1 - gini, 0) AS v FROM (SELECT DISTINCT user_id FROM ev) LEFT JOIN st USING (user_id))
SELECT species, round(b, 6) AS genome_breadth, round(v, 6) AS coverage_evenness FROM f QUALIFY row_number() OVER (PARTITION BY species ORDER BY b DESC, user_id) = 1""")
def species_coverage(spark, d):
    c = intervals.coverage(_errors(spark, d).withColumn("glen", F.lit(2592000.0)), ["user_id"]).withColumn("species", F.col("user_id") % 10)
    s = intervals.species_coverage(c, [], "species", "user_id")
    return s.select("species", R("genome_breadth").alias("genome_breadth"), R("coverage_evenness").alias("coverage_evenness"))


@query("""SELECT user_id, event_id, coalesce(sum(len + 100) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
FROM (SELECT *, length(props)::BIGINT AS len FROM events)""")
def contig_offsets(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.length("props").cast("long").alias("len"))
    return intervals.offsets(e, ["user_id"], "event_id", "len").select("user_id", "event_id", "offset")


_CONF = f"""WITH {HITS_SQL}, {labels_sql()},
conf AS (SELECT identity, coverage FROM lab WHERE target > host)"""
IDS, COVS = (0.90, 0.92, 0.94, 0.95, 0.97, 0.99), (0.3, 0.5, 0.7, 0.8, 0.9)


def confident(spark, d):
    return order_labels(spark, d).where("target > host").select("identity", "coverage")


@query(_CONF + ", q AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, 'p{round(p * 100)}' AS quantile, quantile_cont({m}, {p}) AS value, avg({m}) AS mean, count({m}) AS n FROM conf" for m in ("identity", "coverage") for p in cutoffs.PROBS) + ") SELECT metric, quantile, round(value, 6) AS value, round(mean, 6) AS mean, n FROM q")
def cutoff_distribution(spark, d):
    return cutoffs.distribution(confident(spark, d)).withColumns({"value": R("value"), "mean": R("mean")})


_SWEEP = _CONF + f""", grid AS (SELECT * FROM (VALUES {", ".join(f"({x}::DOUBLE)" for x in IDS)}) a(gt_min_identity), (VALUES {", ".join(f"({x}::DOUBLE)" for x in COVS)}) b(gt_min_coverage)),
sw AS (SELECT gt_min_identity, gt_min_coverage, (SELECT count(*) FROM conf) AS n_confident, count(*) FILTER (identity >= gt_min_identity AND coverage >= gt_min_coverage) AS n_retained FROM grid, conf GROUP BY ALL),
s2 AS (SELECT *, n_retained / greatest(n_confident, 1)::DOUBLE AS frac_retained, abs(gt_min_identity - 0.9) < 1e-9 AND abs(gt_min_coverage - 0.8) < 1e-9 AS is_current FROM sw)"""


@query(_SWEEP + " SELECT gt_min_identity, gt_min_coverage, n_confident, n_retained, round(frac_retained, 6) AS frac_retained, is_current FROM s2")
def cutoff_sweep(spark, d):
    return cutoffs.sweep(confident(spark, d), IDS, COVS).withColumn("frac_retained", R("frac_retained"))


@query(_SWEEP + """ SELECT gt_min_identity, gt_min_coverage, n_confident, n_retained, round(frac_retained, 6) AS frac_retained, is_current FROM s2
ORDER BY frac_retained >= 0.5 DESC, CASE WHEN frac_retained >= 0.5 THEN gt_min_identity END DESC, CASE WHEN frac_retained >= 0.5 THEN gt_min_coverage END DESC, s2.frac_retained DESC, gt_min_identity, gt_min_coverage LIMIT 1""")
def cutoff_recommend(spark, d):
    return cutoffs.recommend(cutoffs.sweep(confident(spark, d), IDS, COVS), 0.5).withColumn("frac_retained", R("frac_retained"))


@query("""WITH u AS (SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s, length(text) AS n FROM documents),
ch AS (SELECT doc_id, n, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT doc_id, n, string_split(s, '') AS cs FROM u WHERE n > 0)),
st AS (SELECT *, CASE WHEN c = lag(c) OVER w THEN 0 ELSE 1 END AS nw, c || lead(c) OVER w || lead(c, 2) OVER w AS t FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
rn AS (SELECT doc_id, c, sum(nw) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM st),
hp AS (SELECT doc_id, max(k) AS k FROM (SELECT doc_id, r, count(*) AS k FROM rn WHERE c <> chr(10) GROUP BY ALL) GROUP BY 1),
tr AS (SELECT doc_id, t, count(*) AS c FROM st WHERE t IS NOT NULL GROUP BY ALL),
du AS (SELECT doc_id, sum(c * (c - 1))::DOUBLE AS q FROM tr GROUP BY 1)
SELECT doc_id, round((n - length(replace(replace(s, 'G', ''), 'C', ''))) / greatest(n, 1)::DOUBLE, 6) AS gc, round(coalesce(k, 0) / greatest(n, 1)::DOUBLE, 6) AS homopolymer_frac,
       round(CASE WHEN n < 3 THEN 0 ELSE q / (2 * (n - 2)) END, 6) AS dust_score
FROM u LEFT JOIN hp USING (doc_id) LEFT JOIN du USING (doc_id)""")
def sequence_complexity(spark, d):
    t = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return t.select("doc_id", R(sequence.gc_fraction(F.col("text"))).alias("gc"), R(sequence.homopolymer_frac(F.col("text"))).alias("homopolymer_frac"), R(sequence.dust_score("text")).alias("dust_score"))


@query("""WITH t AS (SELECT l_orderkey, l_suppkey % 7 AS tx, l_quantity::BIGINT AS c FROM lineitem), a AS (SELECT o_orderkey, o_orderkey % 7 AS tx FROM orders),
s AS (SELECT l_orderkey, coalesce(sum(c), 0) AS total, coalesce(sum(c) FILTER (t.tx = a.tx), 0) AS taxon, count(DISTINCT t.tx) FILTER (t.tx <> 0) AS k FROM t JOIN a ON l_orderkey = o_orderkey GROUP BY 1)
SELECT l_orderkey AS read_id, round(CASE WHEN total > 0 THEN taxon / total::DOUBLE ELSE 0 END, 6) AS k2_conf, round(CASE WHEN total > 0 THEN taxon / total::DOUBLE ELSE 0 END, 6) AS k2_kmers_taxon_frac, k AS k2_distinct_minimizers FROM s""")
def token_lca_features(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat_ws(":", (F.col("l_suppkey") % 7).cast("string"), F.col("l_quantity").cast("long").cast("string"))), " ").alias("kmer_lca"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("k2_taxid"))
    k = t.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("read_id"), "k2_taxid", "kmer_lca")
    return features.kraken_features(k).withColumns({c: R(c) for c in ("k2_conf", "k2_kmers_taxon_frac")})


@query("""SELECT coalesce(a.id, b.id, c.id, e.id) AS read_id, lang, quality::DOUBLE AS quality, n_url::DOUBLE AS n_url, n_item::DOUBLE AS n_item
FROM (SELECT doc_id AS id, lang FROM documents) a FULL JOIN (SELECT doc_id AS id, quality FROM labels) b USING (id)
FULL JOIN (SELECT page_id * 3 AS id, length(url) AS n_url FROM pages) c USING (id) FULL JOIN (SELECT item_id * 5 AS id, length(text) AS n_item FROM benchmark) e USING (id)""".replace("coalesce(a.id, b.id, c.id, e.id)", "id"))
def feature_outer_union(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), "lang")
    b = table(spark, d, "labels").select(F.col("doc_id").alias("read_id"), F.col("quality").cast("double").alias("quality"))
    c = table(spark, d, "pages").select((F.col("page_id") * 3).alias("read_id"), F.length("url").cast("double").alias("n_url"))
    e = table(spark, d, "benchmark").select((F.col("item_id") * 5).alias("read_id"), F.length("text").cast("double").alias("n_item"))
    return features.outer_union([a, b, c, e])


@query("""WITH h AS (SELECT l_orderkey, max(l_extendedprice) FILTER (l_linenumber <= 3) AS human, max(l_extendedprice) FILTER (l_linenumber > 3) AS best FROM lineitem GROUP BY 1)
SELECT 'L' || (o_orderkey % 4) AS library_id, 'r' || (o_orderkey // 4) AS read_id, o_orderstatus AS label, human AS human_bitscore, best AS bitscore, round(human - best, 4) AS human_minus_best_margin,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS read_len, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 5 <> 0 AND o_orderstatus = 'F')::INT END AS end_reason_unblock,
       CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 THEN round((length(o_orderpriority) - length(translate(upper(o_orderpriority), 'GC', ''))) / length(o_orderpriority), 6) END AS gc,
       o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AS has_complexity
FROM orders LEFT JOIN h ON l_orderkey = o_orderkey""")
def library_feature_table(spark, d):
    """Features of several libraries that share read ids, with incomplete statistics, end reasons and sequences."""
    keys = ("library_id", "read_id")
    at = lambda c: (F.concat(F.lit("L"), F.col(c) % 4).alias("library_id"), F.concat(F.lit("r"), F.expr(f"{c} div 4")))
    lib, read = at("o_orderkey")
    o = table(spark, d, "orders").select("*", lib, read.alias("read_id"))
    lib, read = at("l_orderkey")
    hits = table(spark, d, "lineitem").select(lib, read.alias("qname"), F.col("l_extendedprice").alias("score"), F.col("l_discount").alias("identity"), F.col("l_linenumber").alias("_ord"))
    human = features.competitor_features(hits.where("_ord <= 3"), ["library_id"]).drop("human_pident")
    best = hits.where("_ord > 3").groupBy("library_id", F.col("qname").alias("read_id")).agg(F.max("score").alias("bitscore"))
    reasons = o.where("o_orderkey % 5 <> 0").select(*keys, F.when(F.col("o_orderstatus") == "F", "data_service_unblock").otherwise("signal").alias("end_reason"))
    seqs = o.where("o_orderkey % 7 <> 0").select(*keys, F.col("o_orderpriority").alias("sequence"))
    qc = features.qc_features(o.where("o_orderkey % 3 <> 0").select(*keys, F.col("o_totalprice").alias("read_len")), reasons, seqs, keys)
    full = library.library_features(o.select(*keys, F.col("o_orderstatus").alias("label")), [human, best, None, qc], keys)
    return full.select(
        *keys, "label", "human_bitscore", "bitscore", R("human_minus_best_margin", 4).alias("human_minus_best_margin"), "read_len", "end_reason_unblock",
        R("gc").alias("gc"), F.col("dust_score").isNotNull().alias("has_complexity"),
    )


@query("""SELECT page_id, regexp_replace(url, '\\s.*$', '') AS read_id, regexp_replace(url, '[:_].*$', '') AS contig_species,
       CASE WHEN page_id % 3 = 0 THEN 'Escherichia_coli_B' || page_id WHEN page_id % 3 = 1 THEN 'Candida_albicans' ELSE 'Strain_' || page_id END AS species,
       CASE WHEN page_id % 3 = 0 THEN 'Escherichia_coli' WHEN page_id % 3 = 1 THEN 'Candida_albicans' ELSE 'Strain_' || page_id END AS species_group FROM pages""")
def name_normalise(spark, d):
    p = table(spark, d, "pages")
    stem = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Escherichia_coli_b"), F.col("page_id"))).when(F.col("page_id") % 3 == 1, "Candida_albican").otherwise(F.concat(F.lit("Strain_"), F.col("page_id")))
    s = names.canonical_species(stem)
    return p.select("page_id", names.read_id(F.col("url")).alias("read_id"), names.contig_species(F.col("url")).alias("contig_species"), s.alias("species"), names.species_group(s).alias("species_group"))


@query("SELECT event_id, coalesce(contains(lower(CASE WHEN event_type = 'error' THEN 'data_service_UNBLOCK_mux' WHEN event_type = 'view' THEN NULL ELSE event_type END), 'unblock'), false)::INT AS end_reason_unblock FROM events")
def unblock_flag(spark, d):
    reason = F.when(F.col("event_type") == "error", "data_service_UNBLOCK_mux").when(F.col("event_type") != "view", F.col("event_type"))
    return table(spark, d, "events").select("event_id", names.unblock_flag(reason).alias("end_reason_unblock"))


@query("SELECT s_suppkey, coalesce(n_name, s_suppkey::VARCHAR) AS species FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey")
def lookup_with_fallback(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    s = table(spark, d, "supplier")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.col("s_suppkey").cast("string")).alias("species"))
