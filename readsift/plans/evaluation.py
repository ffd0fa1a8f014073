"""Queries on predictions: metrics, sample-by-taxon cells, folds, comparison, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..ml.samples import cell_metrics
from ..operators import compare, folds, intervals, ranking, samples
from ..session import table
from ..stats import mixed, resample, tests
from .bridge import HITS_SQL, PREDICTIONS_SQL, labels_sql, predictions
from .bridge import labels as order_labels
from .inference import bootstrap_sql, mixed_sql
from .reads import _COV, expected_samples, floored_labels

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def R(c, k=6):
    return F.round(c, k)


def rounded(df, *cols, k=6):
    return df.withColumns({c: R(c, k) for c in cols})


METRICS = ("auprc", "prec_at_recall", "fdr_at_recall")


def metric_sql(groups: str, source: str = "preds", targets=ranking.TARGETS, name: str = "met") -> str:
    """Common table expressions ending in ``name``: the metric rows of ``source`` by ``groups``."""
    t = ", ".join(f"({x}::DOUBLE)" for x in targets)
    return f"""
{name}_r AS (
  SELECT {groups}, y, sum((y = 1)::INT) OVER w AS tp, row_number() OVER w AS n, sum((y = 1)::INT) OVER (PARTITION BY {groups}) AS p
  FROM {source} WHERE score IS NOT NULL AND isfinite(score) AND y IS NOT NULL
  WINDOW w AS (PARTITION BY {groups} ORDER BY score DESC, read_id ROWS UNBOUNDED PRECEDING)),
{name} AS (
  SELECT {groups}, recall_target, CASE WHEN n_pos > 0 AND n_neg > 0 THEN ap / n_pos END AS auprc,
         CASE WHEN n_pos > 0 AND n_neg > 0 THEN pr END AS prec_at_recall, CASE WHEN n_pos > 0 AND n_neg > 0 THEN 1 - pr END AS fdr_at_recall, n_pos, n_neg
  FROM (SELECT {groups}, recall_target, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
               sum(tp / n::DOUBLE) FILTER (y = 1) AS ap, max(tp / n::DOUBLE) FILTER (tp / p::DOUBLE >= recall_target) AS pr
        FROM {name}_r, (VALUES {t}) tt(recall_target) GROUP BY {groups}, recall_target))"""


_ROUND = "round(auprc, 6) AS auprc, round(prec_at_recall, 6) AS prec_at_recall, round(fdr_at_recall, 6) AS fdr_at_recall, n_pos, n_neg"


@query(f"WITH {PREDICTIONS_SQL}, {metric_sql('arm, model, fold', targets=(0.95,))} SELECT arm, model, fold, round(auprc, 6) AS auprc, n_pos, n_neg FROM met")
def auprc_by_fold(spark, d):
    return rounded(ranking.auprc(predictions(spark, d), ["arm", "model", "fold"], "y", "score", ["read_id"]), "auprc")


@query(f"WITH {PREDICTIONS_SQL}, {metric_sql('arm, model, scheme, fold')} SELECT arm, model, scheme, fold, recall_target, {_ROUND} FROM met")
def metric_rows(spark, d):
    return rounded(ranking.metric_rows(predictions(spark, d), ["arm", "model", "scheme", "fold"], "y", "score", ["read_id"]), *METRICS)


@query(f"WITH {PREDICTIONS_SQL}, {metric_sql('arm, model', targets=(0.8, 0.9, 0.95, 0.99))} SELECT arm, model, recall_target, round(prec_at_recall, 6) AS prec_at_recall, round(fdr_at_recall, 6) AS fdr_at_recall FROM met")
def precision_at_recall(spark, d):
    m = ranking.metric_rows(predictions(spark, d), ["arm", "model"], "y", "score", ["read_id"], (0.8, 0.9, 0.95, 0.99))
    return rounded(m.select("arm", "model", "recall_target", "prec_at_recall", "fdr_at_recall"), "prec_at_recall", "fdr_at_recall")


_STRAT = f"""WITH {PREDICTIONS_SQL},
v AS (SELECT *, true AS truncated_included FROM preds UNION ALL SELECT *, false FROM preds WHERE end_reason_unblock IS NULL OR end_reason_unblock = 0),
st AS (SELECT *, 'all' AS stratum FROM v UNION ALL SELECT *, titration_level FROM v),
{metric_sql("arm, model, scheme, fold, truncated_included, stratum", "st")}"""


def stratified(spark, d):
    return ranking.stratified_metrics(predictions(spark, d), ["arm", "model", "scheme", "fold"], "y", "score", ["read_id"], "end_reason_unblock", "titration_level")


@query(_STRAT + f" SELECT arm, model, scheme, fold, truncated_included, stratum, recall_target, {_ROUND} FROM met")
def stratified_metrics(spark, d):
    return rounded(stratified(spark, d), *METRICS)


@query(f"WITH {PREDICTIONS_SQL} SELECT arm, model, scheme, fold, round(avg((greatest(0, least(1, score)) - y) ** 2), 6) AS brier, count(*) AS n FROM preds WHERE isfinite(score) GROUP BY ALL")
def calibration_brier(spark, d):
    return rounded(ranking.brier(predictions(spark, d), ["arm", "model", "scheme", "fold"], "y", "score"), "brier")


@query(f"""WITH {PREDICTIONS_SQL}, f AS (SELECT *, 'overall' AS facet, 'all' AS key FROM preds UNION ALL SELECT *, 'taxon', species FROM preds UNION ALL SELECT *, 'concentration', titration_level FROM preds),
{metric_sql("arm, model, facet, key", "f")} SELECT arm, model, facet, key, recall_target, {_ROUND} FROM met""")
def leaderboard_facets(spark, d):
    b = ranking.leaderboard(predictions(spark, d), ["arm", "model"], {"taxon": "species", "concentration": "titration_level"}, "y", "score", ["read_id"])
    return rounded(b, *METRICS)


_SXT = f"""WITH {PREDICTIONS_SQL},
ex AS (SELECT 'D' || i AS donor, lang AS titration_level, source AS species, 100.0::DOUBLE AS expected_cells,
              CASE WHEN (i + length(lang || source)) % 5 = 0 THEN 0.0::DOUBLE WHEN (i + length(lang || source)) % 5 = 1 THEN 0.5::DOUBLE ELSE 0.99::DOUBLE END AS p_detect
       FROM (SELECT DISTINCT lang FROM documents), (SELECT DISTINCT source FROM documents), range(8) r(i)),
exp_ AS (SELECT *, p_detect >= 0.95 AS expected_present FROM ex),
thr AS (SELECT arm, model, quantile_cont(score, 0.75) AS thr_am FROM preds GROUP BY ALL),
dep AS (SELECT arm, model, scheme, fold, donor, titration_level, count(*) AS library_total FROM preds GROUP BY ALL),
cell AS (SELECT arm, model, scheme, fold, donor, titration_level, species, count(*) FILTER (score > thr_am) AS n_reads_above_thr, avg(score) AS mean_score, max(score) AS max_score, max((y = 1)::INT) AS y_obs
         FROM preds JOIN thr USING (arm, model) WHERE species IS NOT NULL GROUP BY ALL),
sx AS (SELECT cell.*, library_total, n_reads_above_thr / greatest(library_total, 1)::DOUBLE * 1e6 AS rpm, coalesce(expected_present, false)::INT AS y
       FROM cell LEFT JOIN dep USING (arm, model, scheme, fold, donor, titration_level) LEFT JOIN exp_ USING (donor, titration_level, species)
       WHERE NOT coalesce(p_detect > 0 AND p_detect < 0.95, false)),
uni AS (SELECT DISTINCT arm, model, scheme, fold, donor, titration_level, species FROM preds p JOIN (SELECT donor, titration_level, species FROM exp_ WHERE expected_present) e USING (donor, titration_level) WHERE true),
mis AS (SELECT * FROM (SELECT DISTINCT arm, model, scheme, fold, donor, titration_level FROM preds) JOIN (SELECT donor, titration_level, species FROM exp_ WHERE expected_present) USING (donor, titration_level)),
fn AS (SELECT mis.* FROM mis ANTI JOIN sx USING (arm, model, scheme, fold, donor, titration_level, species)),
sxt AS (
  SELECT arm, model, scheme, fold, donor, titration_level, species, n_reads_above_thr, mean_score, max_score, y_obs, y, library_total, rpm FROM sx
  UNION ALL
  SELECT arm, model, scheme, fold, donor, titration_level, species, 0, (SELECT min(max_score) - 1 FROM sx), (SELECT min(max_score) - 1 FROM sx), 0, 1, library_total, 0
  FROM fn LEFT JOIN dep USING (arm, model, scheme, fold, donor, titration_level))""".replace(
    "uni AS (SELECT DISTINCT arm, model, scheme, fold, donor, titration_level, species FROM preds p JOIN (SELECT donor, titration_level, species FROM exp_ WHERE expected_present) e USING (donor, titration_level) WHERE true),\n", ""
)


def _expected(spark, d):
    t = table(spark, d, "documents")
    donors = spark.range(8).select(F.concat(F.lit("D"), F.col("id").cast("string")).alias("donor"), F.col("id").alias("i"))
    e = t.select(F.col("lang").alias("titration_level")).distinct().crossJoin(t.select(F.col("source").alias("species")).distinct()).crossJoin(donors)
    k = (F.col("i") + F.length(F.concat("titration_level", "species"))) % 5
    e = e.withColumn("expected_cells", F.lit(100.0)).withColumn("p_detect", F.when(k == 0, 0.0).when(k == 1, 0.5).otherwise(0.99))
    return e.withColumn("expected_present", F.col("p_detect") >= 0.95).drop("i")


def cells(spark, d, coverage=None):
    return samples.aggregate_sample_taxon(predictions(spark, d), _expected(spark, d), coverage)


#: Length of the made-up reference on which a cell's documents lie.
GENOME = 100_000
_CELL_COV = _COV[_COV.index("c AS (SELECT user_id") :].replace("2592000", str(GENOME)).replace("user_id", "donor, titration_level, species").replace("FROM ev)", "FROM iv)").replace("GROUP BY 1)", "GROUP BY ALL)")


def cell_coverage(spark, d):
    """Breadth and evenness of each donor, level and taxon: a document covers its length from a hashed start."""
    t = table(spark, d, "documents").where("source is not null and doc_id % 11 <> 0")
    start = F.col("doc_id") * 9973 % GENOME
    iv = t.select(F.concat(F.lit("D"), F.col("doc_id") % 8).alias("donor"), F.col("lang").alias("titration_level"), F.col("source").alias("species"), start.alias("start"), (start + F.col("n_chars")).alias("end"), F.lit(float(GENOME)).alias("glen"))
    return intervals.coverage(iv, ["donor", "titration_level", "species"])


@query(_SXT + f""", iv AS (SELECT 'D' || (doc_id % 8) AS donor, lang AS titration_level, source AS species, doc_id * 9973 % {GENOME} AS start, doc_id * 9973 % {GENOME} + n_chars AS "end" FROM documents WHERE source IS NOT NULL AND doc_id % 11 <> 0), {_CELL_COV},
cv AS (SELECT donor, titration_level, species, coalesce(genome_breadth, 0) AS b, coalesce(1 - gini, 0) AS v FROM (SELECT DISTINCT donor, titration_level, species FROM iv) LEFT JOIN st USING (donor, titration_level, species))
SELECT arm, model, fold, donor, titration_level, species, y, round(CASE WHEN y_obs = 0 AND n_reads_above_thr = 0 AND max_score < 0 THEN 0 ELSE b END, 6) AS genome_breadth, round(CASE WHEN y_obs = 0 AND n_reads_above_thr = 0 AND max_score < 0 THEN 0 ELSE v END, 6) AS coverage_evenness
FROM sxt LEFT JOIN cv USING (donor, titration_level, species)""")
def cells_with_coverage(spark, d):
    """Cells beside the breadth and evenness of their taxon; a missed taxon has zeros, one without coverage nulls."""
    c = cells(spark, d, cell_coverage(spark, d))
    return rounded(c.select("arm", "model", "fold", "donor", "titration_level", "species", "y", "genome_breadth", "coverage_evenness"), "genome_breadth", "coverage_evenness")


@query(_SXT + ", sm AS (SELECT *, max_score AS score, donor || '|' || titration_level || '|' || species AS read_id FROM sxt), sl AS (SELECT *, 'all' AS stratum FROM sm UNION ALL SELECT *, titration_level FROM sm WHERE titration_level IS NOT NULL)," + metric_sql("arm, model, scheme, fold, stratum", "sl") + f" SELECT arm, model, scheme, fold, stratum, 'sample_taxon' AS level, true AS truncated_included, recall_target, {_ROUND} FROM met")
def cell_metrics_by_level(spark, d):
    return rounded(cell_metrics(cells(spark, d)), *METRICS)


@query(_SXT + " SELECT arm, model, scheme, fold, donor, titration_level, species, n_reads_above_thr, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score, y_obs, y, library_total, round(rpm, 6) AS reads_above_thr_per_million FROM sxt")
def sample_taxon_aggregate(spark, d):
    c = rounded(cells(spark, d), "mean_score", "max_score", "reads_above_thr_per_million")
    return c.select("arm", "model", "scheme", "fold", "donor", "titration_level", "species", "n_reads_above_thr", "mean_score", "max_score", "y_obs", "y", "library_total", "reads_above_thr_per_million")


@query(_SXT + " SELECT arm, model, fold, donor, titration_level, species, round(max_score, 6) AS max_score FROM sxt WHERE y = 1 AND y_obs = 0 AND n_reads_above_thr = 0 AND max_score < 0")
def missing_expected_fn(spark, d):
    c = cells(spark, d).where("y = 1 and y_obs = 0 and n_reads_above_thr = 0 and max_score < 0")
    return rounded(c.select("arm", "model", "fold", "donor", "titration_level", "species", "max_score"), "max_score")


@query(_SXT + ", sm AS (SELECT *, max_score AS score, donor || titration_level || species AS read_id FROM sxt)," + metric_sql("arm, model, scheme, fold", "sm") + f" SELECT arm, model, scheme, fold, recall_target, {_ROUND} FROM met")
def sample_taxon_metrics(spark, d):
    c = cells(spark, d).withColumn("cell", F.concat("donor", "titration_level", "species"))
    return rounded(ranking.metric_rows(c, ["arm", "model", "scheme", "fold"], "y", "max_score", ["cell"]), *METRICS)


@query(_SXT + " SELECT arm, model, donor, titration_level, sum(library_total)::BIGINT AS reads, round(avg(rpm), 6) AS mean_per_million FROM sxt GROUP BY ALL")
def depth_per_million(spark, d):
    return cells(spark, d).groupBy("arm", "model", "donor", "titration_level").agg(F.sum("library_total").alias("reads"), R(F.avg("reads_above_thr_per_million")).alias("mean_per_million"))


@query("""SELECT o_orderkey, c_nationkey, round(count(*) OVER () / ((SELECT count(DISTINCT c_nationkey) FROM orders JOIN customer ON o_custkey = c_custkey) * count(*) OVER (PARTITION BY c_nationkey))::DOUBLE, 9) AS weight
FROM orders JOIN customer ON o_custkey = c_custkey""")
def balance_weights(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return rounded(folds.balance_weights(o, ["c_nationkey"]), "weight", k=9)


_ROWS = f"""WITH {HITS_SQL}, {labels_sql()}, rw AS (SELECT read_id, label, 'N' || (o_custkey % 8) AS donor, CASE WHEN l_partkey % 9 <> 0 THEN 'sp' || (l_partkey % 5) END AS species FROM lab),
don AS (SELECT donor, row_number() OVER (ORDER BY donor)::INT AS fold FROM (SELECT DISTINCT donor FROM rw))"""


def _rows(spark, d):
    r = order_labels(spark, d)
    return r.select("read_id", "label", F.concat(F.lit("N"), (F.col("o_custkey") % 8).cast("string")).alias("donor"), F.when(F.col("l_partkey") % 9 != 0, F.concat(F.lit("sp"), (F.col("l_partkey") % 5).cast("string"))).alias("species"))


@query(_ROWS + " SELECT d.fold, CASE WHEN rw.donor = d.donor THEN 'test' ELSE 'train' END AS part, label, count(*) AS n, sum(read_id)::BIGINT AS ids FROM rw, don d WHERE label NOT IN ('ambiguous', 'indeterminate') GROUP BY ALL")
def loeo_masks(spark, d):
    r = _rows(spark, d)
    m = folds.loeo_masks(r, folds.loeo_folds(r))
    return m.groupBy("fold", "part", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("read_id").alias("ids"))


@query(_ROWS + """, sf AS (SELECT species AS test_species, row_number() OVER (ORDER BY species)::INT AS fold FROM (SELECT DISTINCT species FROM rw WHERE label = 'positive' AND species IS NOT NULL)),
m AS (SELECT sf.fold, test_species, label, read_id, CASE WHEN don.fold % 2 = sf.fold % 2 AND (label = 'negative' OR species = test_species) THEN 'test' WHEN don.fold % 2 <> sf.fold % 2 AND (label = 'negative' OR species <> test_species) THEN 'train' END AS part
      FROM rw JOIN don USING (donor), sf WHERE label IN ('positive', 'negative'))
SELECT fold, test_species, part, label, count(*) AS n, sum(read_id)::BIGINT AS ids FROM m WHERE part IS NOT NULL GROUP BY ALL""")
def loto_masks(spark, d):
    r = _rows(spark, d)
    m = folds.loto_masks(r, folds.loto_folds(r, r.where("label = 'positive'")), r)
    return m.groupBy("fold", "test_species", "part", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("read_id").alias("ids"))


@query("""WITH n AS (SELECT o_orderstatus AS s, count(*) AS c, (SELECT count(*) FROM orders) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS r FROM orders) JOIN n ON s = o_orderstatus
WHERE r <= CASE WHEN n <= 1000 THEN c ELSE round(1000 / n::DOUBLE * c) END""")
def stratified_cap(spark, d):
    o = table(spark, d, "orders").withColumn("h", F.md5(F.col("o_orderkey").cast("string")))
    return folds.stratified_cap(o, "o_orderstatus", 1000, ["h", "o_orderkey"]).select("o_orderkey", "o_orderstatus")


_FT = """ft AS (SELECT d.doc_id, (d.doc_id % 4)::INT AS fold, n_chars::DOUBLE AS n_chars, quality::DOUBLE AS quality, length(url)::DOUBLE AS n_url FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN pages ON page_id = d.doc_id)"""


def _features(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars")
    l = table(spark, d, "labels").select("doc_id", "quality")
    p = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.length("url").alias("n_url"))
    f = t.join(l, "doc_id", "left").join(p, "doc_id", "left")
    return f.select("doc_id", (F.col("doc_id") % 4).cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in ("n_chars", "quality", "n_url")])


@query(f"""WITH {_FT}, u AS (SELECT fold, 'n_chars' AS feature, n_chars AS v FROM ft UNION ALL SELECT fold, 'quality', quality FROM ft UNION ALL SELECT fold, 'n_url', n_url FROM ft)
SELECT fold, feature, count(*) AS n_train, count(*) FILTER (v IS NULL) AS n_missing, round(100 * count(*) FILTER (v IS NULL) / count(*)::DOUBLE, 2) AS pct_missing, bool_and(v IS NULL) AS all_na FROM u GROUP BY ALL""")
def missingness_report(spark, d):
    return folds.missingness(_features(spark, d), ["fold"], ["n_chars", "quality", "n_url"])


@query(f"""WITH {_FT}, fo AS (SELECT unnest(range(4))::INT AS f), med AS (SELECT f, median(n_chars) AS a, median(quality) AS b, median(n_url) AS c FROM fo JOIN ft ON fold <> f GROUP BY f)
SELECT doc_id, fold, coalesce(n_chars, a, 0) AS n_chars, coalesce(quality, b, 0) AS quality, coalesce(n_url, c, 0) AS n_url FROM ft JOIN med ON f = fold""")
def imputed_features(spark, d):
    f = _features(spark, d)
    held = spark.range(4).select(F.col("id").cast("int").alias("f"))
    train = f.crossJoin(F.broadcast(held)).where("fold <> f").drop("fold").withColumnRenamed("f", "fold")
    return folds.impute_median(train, f, ["fold"], ["n_chars", "quality", "n_url"])


@query("SELECT count(*) AS n_runs, max(n) AS max_donors, bool_and(n = 1) AS confounded FROM (SELECT s_nationkey, count(DISTINCT s_suppkey % 3) AS n FROM supplier GROUP BY 1)")
def confounder_check(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("run_id"), (F.col("s_suppkey") % 3).alias("donor"))
    return folds.confounded(s)


_AB = f"WITH {HITS_SQL}, {labels_sql('la', 0.90, 0.80)}, {labels_sql('lb', 0.92, 0.50)}, ab AS (SELECT la.read_id, la.identity, la.coverage, la.o_orderpriority AS level, la.label AS label_a, lb.label AS label_b FROM la JOIN lb USING (read_id))"


def _profiles(spark, d):
    a = order_labels(spark, d, 0.90, 0.80).select("read_id", "identity", "coverage", F.col("o_orderpriority").alias("level"), F.col("label").alias("label_a"))
    return a.join(order_labels(spark, d, 0.92, 0.50).select("read_id", F.col("label").alias("label_b")), "read_id")


@query(_AB + " SELECT label_a, label_b, count(*) AS n, label_a <> label_b AS changed FROM ab GROUP BY ALL")
def label_crosstab(spark, d):
    return compare.crosstab(_profiles(spark, d))


@query(_AB + " SELECT label_a, label_b, count(*) AS n, " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("identity", "coverage") for f, n in (("min", "min"), ("median", "med"), ("max", "max"))) + " FROM ab WHERE label_a <> label_b GROUP BY ALL")
def label_flip_profile(spark, d):
    return rounded(compare.flip_profile(_profiles(spark, d), ["identity", "coverage"]), *[f"{c}_{s}" for c in ("identity", "coverage") for s in ("min", "med", "max")])


@query(_AB + ", c AS (SELECT 'A' AS profile, level, label_a AS label FROM ab UNION ALL SELECT 'B', level, label_b FROM ab) SELECT profile, level, label, count(*) AS n FROM c GROUP BY ALL")
def label_composition(spark, d):
    return compare.composition(_profiles(spark, d), "level", {"A": "label_a", "B": "label_b"})


@query(_AB + ", c AS (SELECT 'A' AS profile, level, label_a AS label FROM ab UNION ALL SELECT 'B', level, label_b FROM ab) SELECT level, round(100 * count(*) FILTER (profile = 'A' AND label = 'positive') / (count(*) FILTER (profile = 'A'))::DOUBLE, 2) AS a, round(100 * count(*) FILTER (profile = 'B' AND label = 'positive') / (count(*) FILTER (profile = 'B'))::DOUBLE, 2) AS b FROM c GROUP BY level")
def positive_fraction(spark, d):
    c = compare.composition(_profiles(spark, d), "level", {"a": "label_a", "b": "label_b"})
    share = R(100 * F.sum(F.when(F.col("label") == "positive", F.col("n")).otherwise(0)) / F.sum("n"), 2)
    return c.groupBy("level").pivot("profile", ["a", "b"]).agg(share)


_CALLS = f"WITH {PREDICTIONS_SQL}, mx AS (SELECT * FROM preds WHERE arm = 'combined' AND model = 'mixed'), th AS (SELECT quantile_cont(score, 0.05) AS t FROM mx WHERE y = 1), calls AS (SELECT read_id, donor, titration_level, species, score, CASE WHEN y = 1 THEN 'positive' ELSE 'negative' END AS ground_truth, CASE WHEN score >= t THEN 'positive' ELSE 'negative' END AS model_call FROM mx, th)"


def calls(spark, d):
    return compare.read_calls(predictions(spark, d).where("arm = 'combined' and model = 'mixed'"))


@query(_CALLS + " SELECT read_id, donor, titration_level, species, round(score, 6) AS model_score, ground_truth, model_call, ground_truth = model_call AS correct FROM calls")
def read_calls(spark, d):
    return calls(spark, d).select("read_id", "donor", "titration_level", "species", R("score").alias("model_score"), "ground_truth", "model_call", "correct")


_CONF = "count(*) FILTER (ground_truth = 'positive' AND model_call = 'positive') AS tp, count(*) FILTER (ground_truth = 'negative' AND model_call = 'positive') AS fp, count(*) FILTER (ground_truth = 'positive' AND model_call = 'negative') AS fn, count(*) FILTER (ground_truth = 'negative' AND model_call = 'negative') AS tn, count(*) AS n"


@query(_CALLS + f" SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round((tp + tn) / n::DOUBLE, 6) AS accuracy FROM (SELECT {_CONF} FROM calls)")
def confusion_at_recall(spark, d):
    return rounded(compare.confusion(calls(spark, d)), "precision", "recall", "accuracy")


@query(_CALLS + " SELECT coalesce(ground_truth, 'all') AS ground_truth, coalesce(model_call, 'all') AS model_call, count(*) AS n FROM calls GROUP BY CUBE (ground_truth, model_call)")
def confusion_margins(spark, d):
    return compare.confusion_margins(calls(spark, d))


@query(f"WITH {PREDICTIONS_SQL}, {metric_sql('arm, model, fold', targets=(0.99,))}, a AS (SELECT arm, model, 100 * avg(fdr_at_recall) AS fdr_pct, 100 * stddev_samp(fdr_at_recall) AS sd FROM met GROUP BY ALL) SELECT arm, model, round(fdr_pct, 6) AS fdr_pct, round(sd, 6) AS sd, round(fdr_pct / (SELECT fdr_pct FROM a WHERE arm = 'combined' AND model = 'size'), 3) AS fold_change FROM a")
def ablation_fold_change(spark, d):
    m = ranking.metric_rows(predictions(spark, d), ["arm", "model", "fold"], "y", "score", ["read_id"], (0.99,))
    a = m.groupBy("arm", "model").agg((100 * F.avg("fdr_at_recall")).alias("fdr_pct"), (100 * F.stddev_samp("fdr_at_recall")).alias("sd")).withColumn("one", F.lit(1))
    f = compare.fold_change(a, "fdr_pct", (F.col("arm") == "combined") & (F.col("model") == "size"), ["one"]).drop("one")
    return rounded(f, "fdr_pct", "sd")


@query(f"WITH {PREDICTIONS_SQL}, {metric_sql('model, titration_level', '(SELECT * FROM preds WHERE arm = ' + chr(39) + 'combined' + chr(39) + ')', (0.95,))} SELECT titration_level AS level, round(max(prec_at_recall) FILTER (model = 'mixed'), 6) AS mixed, round(max(prec_at_recall) FILTER (model = 'size'), 6) AS size, round(max(prec_at_recall) FILTER (model = 'mixed') - max(prec_at_recall) FILTER (model = 'size'), 6) AS gap FROM met GROUP BY 1")
def titration_gap(spark, d):
    m = ranking.metric_rows(predictions(spark, d).where("arm = 'combined'"), ["model", "titration_level"], "y", "score", ["read_id"], (0.95,))
    g = m.groupBy(F.col("titration_level").alias("level")).pivot("model", ["mixed", "size"]).agg(F.max("prec_at_recall"))
    return rounded(g.withColumn("gap", F.col("mixed") - F.col("size")), "mixed", "size", "gap")


_FOLDM = f"WITH {PREDICTIONS_SQL}, {metric_sql('arm, model, fold', targets=(0.95,))}"
_PAIRS = f"{_FOLDM}, pr AS (SELECT a.fold, a.auprc - b.auprc AS d, 'mixed-size' AS id FROM met a JOIN met b USING (fold) WHERE a.arm = 'combined' AND a.model = 'mixed' AND b.arm = 'combined' AND b.model = 'size' UNION ALL SELECT a.fold, a.auprc - b.auprc, 'mixed-single' FROM met a JOIN met b USING (fold) WHERE a.arm = 'combined' AND a.model = 'mixed' AND b.arm = 'single' AND b.model = 'size')"


def fold_pairs(spark, d):
    m = ranking.auprc(predictions(spark, d), ["arm", "model", "fold"], "y", "score", ["read_id"]).select("arm", "model", "fold", F.col("auprc").alias("value"))
    of = lambda a, mo: F.max(F.when((F.col("arm") == a) & (F.col("model") == mo), F.col("value")))
    # One pass over the metrics: each fold's values side by side.
    g = m.groupBy("fold").agg(of("combined", "mixed").alias("a"), of("combined", "size").alias("mixed-size"), of("single", "size").alias("mixed-single"))
    long = g.select("fold", "a", F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.col(i).alias("b")) for i in ("mixed-size", "mixed-single")])).alias("x"))
    return long.select("fold", "a", "x.b", (F.col("a") - F.col("x.b")).alias("d"), "x.id").where("a is not null and b is not null")


_WIL = _PAIRS + """, nz AS (SELECT id, d, round(abs(d), 12) AS a FROM pr WHERE d IS NOT NULL AND d <> 0),
rk AS (SELECT id, d, a, rank() OVER (PARTITION BY id ORDER BY a) + (count(*) OVER (PARTITION BY id, a) - 1) / 2.0::DOUBLE AS r, row_number() OVER (PARTITION BY id ORDER BY a, d) - 1 AS i FROM nz),
ob AS (SELECT id, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w, sum(r) / 2 AS m FROM rk GROUP BY 1),
en AS (SELECT ob.id, k, n, ob.w, m, coalesce(sum(r) FILTER ((k >> i) & 1 = 1), 0) AS x FROM ob, LATERAL (SELECT unnest(range(0, (1 << n::INT)::BIGINT)) AS k) s JOIN rk ON rk.id = ob.id GROUP BY ALL),
wx AS (SELECT id, n, w AS statistic, avg((abs(x - m) >= abs(w - m) - 1e-9)::INT) AS p_value FROM en GROUP BY ALL)"""


def wilcoxon(spark, d):
    return tests.wilcoxon_exact(fold_pairs(spark, d), ["id"])


@query(_WIL + " SELECT id, n, statistic, round(p_value, 9) AS p_value FROM wx")
def wilcoxon_exact(spark, d):
    return rounded(wilcoxon(spark, d), "p_value", k=9)


@query("""WITH p(id, p) AS (VALUES ('H1', 0.01::DOUBLE), ('H2', 0.0078125::DOUBLE), ('H3', 1e-12::DOUBLE), ('H4', 0.04::DOUBLE), ('H5', NULL), ('H6', 0.03::DOUBLE)),
o AS (SELECT id, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p NULLS LAST, id) AS i FROM p)
SELECT id, p, round(CASE WHEN p IS NOT NULL THEN least(1, max(1 - (1 - p) ** (m - i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) END, 9) AS p_adjusted FROM o""")
def holm_sidak(spark, d):
    p = spark.createDataFrame([("H1", 0.01), ("H2", 0.0078125), ("H3", 1e-12), ("H4", 0.04), ("H5", None), ("H6", 0.03)], "id string, p double")
    return rounded(tests.holm_sidak(p), "p_adjusted", k=9)


@query(f"""WITH {PREDICTIONS_SQL}, {metric_sql("model, fold, titration_level", "(SELECT * FROM preds WHERE arm = 'combined')", (0.95,))},
c AS (SELECT CASE WHEN model = 'mixed' THEN 'a' ELSE 'b' END AS me, CASE WHEN titration_level IN ('es', 'de') THEN 'low' ELSE 'high' END AS g, auprc FROM met WHERE auprc IS NOT NULL),
k AS (SELECT me, g, avg(auprc) AS m, count(*) AS n, coalesce(var_samp(auprc), 0) AS v FROM c GROUP BY ALL),
e AS (SELECT sum(CASE WHEN (me = 'a') = (g = 'low') THEN m ELSE -m END) AS estimate, sum((n - 1) * v) AS ss, sum(n) AS n, sum(1 / n::DOUBLE) AS inv FROM k)
SELECT round(estimate, 6) AS estimate, n::BIGINT AS n, round(estimate / sqrt(ss / (n - 4) * inv), 6) AS t FROM e""")
def interaction_did(spark, d):
    m = ranking.auprc(predictions(spark, d).where("arm = 'combined'"), ["model", "fold", "titration_level"], "y", "score", ["read_id"])
    m = m.withColumn("method", F.when(F.col("model") == "mixed", "a").otherwise("b")).withColumn("level_group", F.when(F.col("titration_level").isin("es", "de"), "low").otherwise("high"))
    return rounded(tests.interaction(m), "estimate", "t")


@query(f"""WITH {PREDICTIONS_SQL}, x AS (SELECT score, end_reason_unblock AS g FROM preds WHERE arm = 'combined' AND model = 'size' AND y = 1),
r AS (SELECT score, g, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM x WHERE g IN (0, 1)),
s AS (SELECT count(*) FILTER (g = 1) AS a, count(*) FILTER (g = 0) AS b, sum(r) FILTER (g = 1) - count(*) FILTER (g = 1) * (count(*) FILTER (g = 1) + 1) / 2.0::DOUBLE AS w FROM r)
SELECT a AS n_1, b AS n_0, w, (SELECT median(score) FROM x WHERE g = 1) AS median_1, (SELECT median(score) FROM x WHERE g = 0) AS median_0 FROM s""")
def rank_sum(spark, d):
    p = predictions(spark, d).where("arm = 'combined' and model = 'size' and y = 1")
    return tests.rank_sum(p, "end_reason_unblock", "score").select("n_1", "n_0", "w", "median_1", "median_0")


@query(_FOLDM + " SELECT arm, model, round(m, 6) AS mean_auprc FROM (SELECT arm, model, avg(auprc) AS m FROM met GROUP BY ALL) ORDER BY m DESC, arm, model LIMIT 1")
def best_family(spark, d):
    m = ranking.auprc(predictions(spark, d), ["arm", "model", "fold"], "y", "score", ["read_id"])
    best = m.groupBy("arm", "model").agg(F.avg("auprc").alias("mean_auprc")).orderBy(F.desc("mean_auprc"), "arm", "model").limit(1)
    return rounded(best, "mean_auprc")


_HYP = _WIL + """, md AS (SELECT id, median(d) AS effect FROM pr GROUP BY 1), fx AS (SELECT md.id, effect, coalesce(p_value < 0.05, false) AS significant FROM md LEFT JOIN wx USING (id)),
fb AS (SELECT id, -effect / 2 AS effect, significant FROM fx WHERE id <> 'mixed-single'), od(id, ord) AS (VALUES ('mixed-single', 1), ('mixed-size', 2))"""


def effects(spark, d):
    md = fold_pairs(spark, d).groupBy("id").agg(F.median("d").alias("effect"))
    return md.join(wilcoxon(spark, d).select("id", "p_value"), "id", "left").withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def _order(spark):
    return spark.createDataFrame([("mixed-single", 1), ("mixed-size", 2)], "id string, ord int")


@query(_HYP + " SELECT ord, id, round(fx.effect, 6) AS effect_a, round(fb.effect, 6) AS effect_b, fx.significant AS sig_a, coalesce(fb.significant::VARCHAR, '-') AS sig_b, round(fb.effect - fx.effect, 6) AS delta, round(CASE WHEN fx.effect <> 0 THEN fb.effect / fx.effect END, 6) AS ratio, coalesce((sign(fx.effect) = sign(fb.effect))::VARCHAR, '-') AS sign_agree, coalesce((fx.significant = fb.significant)::VARCHAR, '-') AS verdict_agree FROM fx FULL JOIN fb USING (id) JOIN od USING (id)")
def concordance(spark, d):
    a = effects(spark, d)
    b = a.where("id <> 'mixed-single'").withColumn("effect", -F.col("effect") / 2)
    c = rounded(compare.concordance(a, b, _order(spark)), "effect_a", "effect_b", "delta", "ratio")
    return c.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in ("sig_b", "sign_agree", "verdict_agree")})


@query(_HYP + """ SELECT ord, id AS hypothesis, 'primary' AS family, CASE WHEN abs(effect) >= 0.01 THEN printf('%.3f', effect) ELSE printf('%.2e', effect) END AS effect, '-' AS ci_95,
CASE WHEN p_value < 1e-4 THEN printf('%.1e', p_value) ELSE printf('%.4f', p_value) END AS p_raw, CASE WHEN adj < 1e-4 THEN printf('%.1e', adj) ELSE printf('%.4f', adj) END AS p_holm_sidak,
CASE WHEN adj < 0.05 THEN 'yes' ELSE 'no' END AS significant, '' AS note
FROM (SELECT *, least(1, max(1 - (1 - p_value) ** (m - i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS adj FROM (SELECT fx.id, effect, p_value, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, id) AS i FROM fx JOIN wx USING (id))) JOIN od USING (id)""")
def hypothesis_table(spark, d):
    none = F.lit(None).cast("double")
    e = tests.holm_sidak(effects(spark, d), "id", "p_value")
    adjusted = F.col("p_adjusted")
    r = e.select("id", F.lit("primary").alias("family"), F.col("effect").alias("median_diff"), none.alias("ci_lo"), none.alias("ci_hi"), F.col("p_value").alias("wilcox_p"), adjusted.alias("holm_sidak_p"), (adjusted < 0.05).alias("significant"), F.lit(None).cast("string").alias("note"))
    return compare.hypothesis_table(r, _order(spark))


@query(f"{_PAIRS}, {bootstrap_sql('pr')} SELECT id, n AS n_folds, round(median_diff, 6) AS median_diff, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM ci")
def bootstrap_ci(spark, d):
    """Percentile intervals of the median paired differences, with draws that SQL makes alike."""
    b = resample.median_intervals(fold_pairs(spark, d), ["id"]).withColumnRenamed("n", "n_folds")
    return rounded(b, "median_diff", "ci_lo", "ci_hi")


@query(f"""WITH {PREDICTIONS_SQL}, {metric_sql("model, fold, titration_level", "(SELECT * FROM preds WHERE arm = 'combined')", (0.95,))},
mi AS (SELECT 'mixed-size' AS id, fold AS g, auprc AS y, (model = 'mixed')::INT::DOUBLE AS x1 FROM met WHERE model IN ('mixed', 'size')), {mixed_sql('mi', 1)}
SELECT id, round(estimate, 6) AS mixed_estimate, round(p_value, 9) AS mixed_p, n AS n_units, CASE WHEN estimate IS NULL THEN 'none' ELSE 'reml' END AS engine FROM mi_fit""")
def mixed_supplement(spark, d):
    """The gain of the mixed score over size over folds and levels, with a random intercept a fold."""
    m = ranking.auprc(predictions(spark, d).where("arm = 'combined' and model in ('mixed', 'size')"), ["model", "fold", "titration_level"], "y", "score", ["read_id"])
    m = m.select(F.lit("mixed-size").alias("id"), "fold", (F.col("model") == "mixed").alias("treated"), "auprc")
    e = mixed.mixed_effect(m, ["id"], "fold", "treated", "auprc")
    e = e.select("id", F.col("estimate").alias("mixed_estimate"), F.col("p_value").alias("mixed_p"), F.col("n").alias("n_units"), "engine")
    return rounded(rounded(e, "mixed_estimate"), "mixed_p", k=9)


__all__ = ["QUERIES", "ORACLES", "expected_samples", "floored_labels"]
