"""Queries of the study's hypotheses and of the model runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..ml import models, run, store
from ..operators import ranking
from ..operators.folds import fold_table
from ..operators.profiles import Profile
from ..session import scratch, table
from ..stages import Run, Stage, run_folder
from ..stats import study
from .bridge import LEVELS, PREDICTIONS_SQL, predictions
from .evaluation import _ROWS as LABELLED_SQL, _WIL, _rows as labelled_rows, metric_sql, rounded
from .inference import bootstrap_sql, mixed_sql
from .learning import FEATURES, training_table

#: Share of signal in the score of each arm, model and scheme (fixed values of the view below).
SIGNAL = (
    ("combined", "fixed_threshold", "LOEO", 0.30), ("combined", "glm", "LOEO", 0.45), ("combined", "random_forest", "LOEO", 0.50),
    ("combined", "boosted_trees", "LOEO", 0.55), ("combined", "glmm", "LOEO", 0.44), ("combined", "glmm_none", "LOEO", 0.46),
    ("combined", "glmm_truth", "LOEO", 0.48), ("combined", "glmm_classifier", "LOEO", 0.43), ("blast_only", "boosted_trees", "LOEO", 0.40),
    ("kraken2_only", "boosted_trees", "LOEO", 0.35), ("combined_minus_H5_key", "boosted_trees", "LOEO", 0.42), ("combined", "boosted_trees", "LOTO", 0.33),
)


def study_predictions(spark, d):
    """Orders as scored reads: status F is positive, eight donors, levels by priority; scores mix truth and two hashes."""
    h = lambda k: ((F.col("o_orderkey") * k) % 1000) / 1000.0
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("o_orderpriority")]
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 8 + 1).cast("int").alias("fold"), (F.col("o_custkey") % 25).alias("taxon"), level.alias("titration_level"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("end_reason_unblock"), h(7919).alias("h1"), h(6271).alias("h2"),
    )
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(m).alias("model"), F.lit(s).alias("scheme"), (F.lit(w) * ((F.col("y") + F.col("h1")) / 2) + F.lit(1 - w) * F.col("h2")).alias("score")) for a, m, s, w in SIGNAL]))
    return o.withColumn("m", each).select("m.*", "read_id", "fold", "taxon", "titration_level", "y", "end_reason_unblock")


_KEY = ["arm", "model", "scheme", "fold"]


def study_metrics(spark, d, levels=True, cells=True):
    """Metric rows of reads, in all and by level, and of cells (donor, level and taxon; score and truth are means).

    Callers that use no levels or no cells leave them out. Scores repeat, so they are counted first.
    """
    p = study_predictions(spark, d)
    m = ranking.counted_metric_rows(p, _KEY, "y", "score", ["read_id"], (0.95,), level="titration_level" if levels else None)
    m = m.select(*_KEY, "stratum" if levels else F.lit("all").alias("stratum"), "auprc", "n_pos", "n_neg", F.lit("read").alias("level"))
    if not cells:
        return m
    cell = p.where("scheme = 'LOEO' and arm = 'combined'").groupBy(*_KEY, "titration_level", "taxon").agg(F.avg("score").alias("score"), (F.avg("y") >= 0.5).cast("int").alias("y"))
    cell = cell.withColumn("cell", F.concat_ws("|", "titration_level", "taxon"))
    c = ranking.auprc(cell, _KEY, "y", "score", ["cell"]).withColumn("stratum", F.lit("all")).withColumn("level", F.lit("sample_taxon"))
    return m.unionByName(c)


def study_calibration(spark, d):
    return study_predictions(spark, d).groupBy(*_KEY).agg(F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("brier"))


def study_contrasts(spark, d):
    """The paired contrasts by chosen family: folds, median difference and exact p."""
    v = study.vectors(study_metrics(spark, d, levels=False), study_calibration(spark, d)).persist()  # folds x arms x models
    family = study.choose_family(None, v)
    pairs = study.design(spark, family, study.choose_family(None, v, study.TREES), study.choose_arm(v, family))
    e = pairs.select("id", "family", "comparison").join(study.contrasts(v, pairs), "id")
    return rounded(rounded(e, "median_diff"), "wilcox_p", k=9)


def study_hypotheses(spark, d):
    """All rows H1 to H12 with intervals, adjusted p and significance."""
    m = study_metrics(spark, d).persist()  # a row a metric
    h = study.hypothesis_rows(m, study_predictions(spark, d), study_calibration(spark, d).persist())
    return rounded(rounded(h, "median_diff", "ci_lo", "ci_hi"), "wilcox_p", "holm_sidak_p", k=9)


def study_mixed_supplement(spark, d):
    """H1, H2 and H4 over the rows of all folds and levels, with a random intercept a fold."""
    return rounded(rounded(study.mixed_supplement(study_metrics(spark, d, cells=False).persist()), "mixed_estimate"), "mixed_p", k=9)


def study_choice(spark, d):
    """The family, tree family and single arm that the contrasts use, chosen by outer folds."""
    v = study.vectors(study_metrics(spark, d, levels=False, cells=False)).persist()
    family = study.choose_family(None, v)
    return spark.createDataFrame([(family, study.choose_family(None, v, study.TREES), study.choose_arm(v, family))], "family string, tree string, single string")


BLOCKS = {"length": ("n_chars", "n_lines"), "shares": ("upper_share", "symbol_share")}


def run_table(spark, d):
    """Labelled documents as a feature table of three donors and the languages as taxa."""
    t = training_table(spark, d).withColumn("donor", F.concat(F.lit("D"), (F.col("read_id") % 3).cast("string")))
    label = F.when(F.col("y") == 1, "positive").otherwise("negative")
    return t.withColumn("label", label).withColumn("titration_level", F.lit("c1")).withColumn("end_reason_unblock", F.lit(0)).drop("y")


def model_run(spark, d):
    """Rows, scores and failures of a whole run by arm, model, scheme and fold, with the logistic model in all roles."""
    t = run_table(spark, d).persist()  # read once for all folds; labelled rows only
    arms = {"combined": FEATURES, "length_only": list(BLOCKS["length"])}
    p = run.run(t, arms, {"glm": models.glm}, BLOCKS, {"shares": ["shares"], "nothing": []}, {"none": None, "truth": "species", "absent": "no_such_column"}, best="glm", into=scratch(spark))
    return p.groupBy("arm", "model", "scheme", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_pos"), F.count("score").alias("n_scored"), F.count("error").alias("n_failed"))


def stored_read_calls(spark, d):
    """Predictions are stored, one model's folds are replaced, and its calls exported beside the taxa of the reads."""
    path = scratch(spark)
    p = predictions(spark, d)
    store.save(p.withColumn("score", F.when(F.col("model") == "mixed", F.lit(0.0)).otherwise(F.col("score"))), path)
    store.save(p.where("model = 'mixed'"), path)
    taxon = F.when(F.col("doc_id") % 7 == 0, "NA").when(F.col("doc_id") % 5 != 0, F.col("source"))
    taxa = table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), taxon.alias("top_species"), F.col("lang").alias("top_genus")).where("read_id % 3 <> 0")
    return store.in_export_order(store.export_read_calls(spark, path, taxa, "combined", "mixed"))


def fold_artefact(spark, d):
    """The fold table of labelled orders, stored and read back; donors of a part and of a group joined by commas."""
    path = scratch(spark)
    store.save_folds(fold_table(labelled_rows(spark, d), k=3), path)
    text = F.array_join(F.transform("inner", lambda g: F.concat(g["group"].cast("string"), F.lit(":"), F.array_join(g["donors"], ","))), ";")
    return store.load_folds(spark, path).select("scheme", "fold", "test_species", F.array_join("test_donors", ",").alias("test_donors"), F.array_join("train_donors", ",").alias("train_donors"), text.alias("inner_groups"))


def staged_run(spark, d):
    """Three stages with their tables in the folder of the cut-offs: the first alone, then what is left; rows of each fold's parts."""
    folder = run_folder(scratch(spark), Profile())
    labels = Stage("labels", ("labels",), lambda read: {"labels": run.usable(run_table(spark, d)).select("read_id", "donor", "species", "y", "label")})
    folds = Stage("folds", ("folds",), lambda read: {"folds": fold_table(read("labels"), k=2)}, ("labels",))

    def counted(read):
        held = read("folds").where("scheme = 'LOEO'").select("fold", F.explode("test_donors").alias("donor"))
        by = read("labels").groupBy("donor").agg(F.count(F.lit(1)).alias("n_test"), F.sum("y").cast("long").alias("n_test_pos"))
        return {"parts": held.join(F.broadcast(by), "donor").select("fold", "donor", "n_test", "n_test_pos")}  # a row a donor

    r = Run(spark, folder, [labels, folds, Stage("parts", ("parts",), counted, ("labels", "folds"))])
    r.keep_settings(Profile(), k=2)
    r.run(only=["labels"])
    ran = ",".join(r.run())
    kept = r.read("settings").select("name", "min_identity", "k")
    return r.read("parts").crossJoin(F.broadcast(kept)).withColumn("ran", F.lit(ran))  # one row of settings


def run_inner_scores(spark, d):
    """Inner average precision of the logistic model for each held-out donor."""
    t = run_table(spark, d).persist()
    return run.inner_scores(t, "combined", FEATURES, {"glm": models.glm}, k=2)


_LEVEL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVELS.items()) + " END"
_SIGNAL = ", ".join(f"('{a}', '{m}', '{s}', {w}::DOUBLE, {1 - w!r}::DOUBLE)" for a, m, s, w in SIGNAL)
STUDY_SQL = f"""
sig(arm, model, scheme, w, u) AS (VALUES {_SIGNAL}),
so AS (
  SELECT o_orderkey AS read_id, (o_custkey % 8 + 1)::INT AS fold, o_custkey % 25 AS taxon, {_LEVEL} AS titration_level, (o_orderstatus = 'F')::INT AS y,
         ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE AS h1, ((o_orderkey * 6271) % 1000) / 1000.0::DOUBLE AS h2
  FROM orders),
sp AS (SELECT arm, model, scheme, w * ((y + h1) / 2) + u * h2 AS score, so.* FROM so, sig),
sc AS (SELECT arm, model, scheme, fold, titration_level || '|' || taxon AS read_id, avg(score) AS score, (avg(y) >= 0.5)::INT AS y FROM sp WHERE scheme = 'LOEO' AND arm = 'combined' GROUP BY arm, model, scheme, fold, titration_level, taxon),
{metric_sql("arm, model, scheme, fold", "sp", (0.95,), "mr").strip()},
{metric_sql("arm, model, scheme, fold", "sc", (0.95,), "mc").strip()},
sv AS (
  SELECT 'auprc' AS metric, arm, model, scheme, 'read' AS level, fold, auprc AS value FROM mr
  UNION ALL SELECT 'auprc', arm, model, scheme, 'sample_taxon', fold, auprc FROM mc
  UNION ALL SELECT 'brier', arm, model, scheme, 'read', fold, avg((score - y) * (score - y)) FROM sp GROUP BY arm, model, scheme, fold),
rd AS (SELECT * FROM sv WHERE metric = 'auprc' AND level = 'read' AND scheme = 'LOEO'),
fam AS (SELECT model FROM rd WHERE arm = 'combined' AND model IN ('glm', 'random_forest', 'boosted_trees', 'glmm') GROUP BY 1 ORDER BY avg(value) DESC LIMIT 1),
tree AS (SELECT model FROM rd WHERE arm = 'combined' AND model IN ('random_forest', 'boosted_trees') GROUP BY 1 ORDER BY avg(value) DESC LIMIT 1),
one AS (SELECT arm FROM rd WHERE arm IN ('blast_only', 'kraken2_only') AND model = (FROM fam) GROUP BY 1 ORDER BY avg(value) DESC LIMIT 1),
ch AS (SELECT (FROM fam) AS f, (FROM tree) AS t, coalesce((FROM one), 'blast_only') AS s)"""
_DESIGN_SQL = """
de(id, family, metric, arm_a, model_a, level_a, arm_b, model_b, level_b, comparison) AS (
  SELECT 'H1', 'primary', 'auprc', 'combined', f, 'read', s, f, 'read', 'AUPRC combined(' || f || ') - ' || s || '(' || f || ')' FROM ch
  UNION ALL SELECT 'H2', 'primary', 'auprc', 'combined', f, 'read', 'combined', 'fixed_threshold', 'read', 'AUPRC combined(' || f || ') - combined(fixed_threshold)' FROM ch
  UNION ALL SELECT 'H4', 'primary', 'auprc', 'combined', t, 'read', 'combined', 'glm', 'read', 'AUPRC combined(' || t || ') - combined(glm)' FROM ch
  UNION ALL SELECT 'H5', 'primary', 'auprc', 'combined', 'boosted_trees', 'read', 'combined_minus_H5_key', 'boosted_trees', 'read', 'AUPRC combined - combined_minus_H5_key (boosted_trees)'
  UNION ALL SELECT 'H6', 'primary', 'auprc', 'combined', f, 'sample_taxon', 'combined', 'fixed_threshold', 'read', 'AUPRC sample_taxon(' || f || ') - read(fixed_threshold)' FROM ch
  UNION ALL SELECT 'H9', 'secondary', 'auprc', 'combined', 'glmm_none', 'read', 'combined', 'glm', 'read', 'AUPRC GLMM(1|donor) - GLM'
  UNION ALL SELECT 'H12', 'secondary', 'brier', 'combined', 'fixed_threshold', 'read', 'combined', f, 'read', 'Brier fixed_threshold - ' || f FROM ch
  UNION ALL SELECT 'H5b', 'secondary', 'auprc', 'combined', 'sxt_full', 'sample_taxon', 'combined', 'sxt_minus_breadth', 'sample_taxon', 'AUPRC sample_taxon full - minus breadth'
  UNION ALL SELECT 'H9b_' || x, 'secondary', 'auprc', 'combined', 'glmm_' || x, 'read', 'combined', 'glmm_none', 'read', 'AUPRC GLMM(1|donor+1|species[' || x || ']) - GLMM(1|donor)' FROM (VALUES ('truth'), ('classifier')) v(x)
  UNION ALL SELECT x, 'source', 'auprc', 'combined', 'glmm_' || x, 'read', 'combined', 'glm', 'read', 'AUPRC GLMM[' || x || '] - GLM' FROM (VALUES ('none'), ('truth'), ('classifier')) v(x)),
pr AS (
  SELECT de.id, a.fold, a.value - b.value AS d
  FROM de JOIN sv a ON a.metric = de.metric AND a.arm = arm_a AND a.model = model_a AND a.level = level_a AND a.scheme = 'LOEO'
  JOIN sv b ON b.metric = de.metric AND b.arm = arm_b AND b.model = model_b AND b.level = level_b AND b.scheme = 'LOEO' AND b.fold = a.fold)"""
_EXACT = _WIL[_WIL.index("nz AS") :]
_LEVELS_SQL = metric_sql("arm, model, scheme, fold, titration_level", "sp", (0.95,), "ml").strip()
_NOTES = ", ".join(f"('{k}', '{v}')" for k, v in (("H4", "tree family by inner scores"), ("H5", "margin and human blocks; breadth is H5b"), ("H9", "donor term alone"), ("H12", "positive: the model is better calibrated"), ("H5b", "needs coverage of cells"), *[(f"H9b_{x}", f"species source = {x}") for x in study.SOURCES]))
_NOT_RUN = " UNION ALL ".join(f"SELECT '{k}', 'secondary', '{c}', NULL, NULL, NULL, NULL, NULL, '{n}'" for k, (c, n) in study.NOT_RUN.items())
_ROWS_SQL = f"""
{bootstrap_sql("pr", "bc")},
md AS (SELECT id, count(*) AS nf, median(d) AS md FROM pr GROUP BY 1),
sg AS (SELECT '; sign of GLMM - GLM by source {{' || string_agg(id || ':' || CASE WHEN sign(md) >= 0 THEN '+' ELSE '' END || sign(md)::INT, ', ' ORDER BY id) || CASE WHEN count(DISTINCT sign(md)) FILTER (md <> 0) <= 1 THEN '}} -> ROBUST' ELSE '}} -> SOURCE-DEPENDENT' END AS t FROM md WHERE id IN ('none', 'truth', 'classifier')),
nt(id, t) AS (VALUES {_NOTES}),
hi AS (
  SELECT 'H3' AS id, fold AS g, auprc AS y, (model = f)::INT::DOUBLE AS x1, (titration_level IN ('c4', 'c5'))::INT::DOUBLE AS x2, CASE WHEN model = f AND titration_level IN ('c4', 'c5') THEN 1 ELSE 0 END::DOUBLE AS x3
  FROM ml, ch WHERE arm = 'combined' AND scheme = 'LOEO' AND model IN (f, 'fixed_threshold') AND titration_level IN ('c1', 'c2', 'c4', 'c5')),
{mixed_sql("hi", 3)},
lv AS (SELECT scheme, value FROM sv WHERE metric = 'auprc' AND arm = 'combined' AND model = 'boosted_trees' AND level = 'read'),
lo AS (SELECT 'H10' AS id, value AS d FROM lv WHERE scheme = 'LOTO'), {bootstrap_sql("lo", "lc")},
lm AS (SELECT median(value) FILTER (scheme = 'LOEO') AS a, median(value) FILTER (scheme = 'LOTO') AS b, count(*) FILTER (scheme = 'LOTO') AS n FROM lv),
tp AS (SELECT y, score, (read_id % 3 = 0)::INT AS u FROM sp WHERE arm = 'combined' AND model = 'boosted_trees' AND scheme = 'LOEO'),
tr AS (SELECT u, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r, (count(*) OVER (PARTITION BY score))::DOUBLE AS t FROM tp WHERE y = 0),
ts AS (SELECT sum(r) FILTER (u = 1) AS r1, (count(*) FILTER (u = 1))::DOUBLE AS a, (count(*) FILTER (u = 0))::DOUBLE AS b, sum(t * t - 1) AS tie, median(score) FILTER (u = 1) - median(score) FILTER (u = 0) AS shift FROM tr),
tz AS (SELECT shift, greatest(abs(r1 - a * (a + 1) / 2 - a * b / 2) - 0.5, 0) / sqrt(a * b / 12 * (a + b + 1 - tie / ((a + b) * (a + b - 1)))) AS z FROM ts),
tw AS (SELECT shift, z, 1 / (1 + 0.2316419::DOUBLE * z) AS k FROM tz),
tq AS (SELECT shift, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * k * (0.319381530::DOUBLE + k * (-0.356563782::DOUBLE + k * (1.781477937::DOUBLE + k * (-1.821255978::DOUBLE + k * 1.330274429::DOUBLE)))) AS p FROM tw),
tf AS (SELECT avg(u) AS share FROM tp, (SELECT quantile_cont(score, 0.75) AS q FROM tp) WHERE score > q AND y = 0),
al(id, family, comparison, n_folds, median_diff, ci_lo, ci_hi, wilcox_p, note) AS (
  SELECT de.id, family, comparison, coalesce(nf, 0), md, ci_lo, ci_hi, p_value, coalesce(nt.t, '') || CASE WHEN de.id = 'H9' THEN sg.t ELSE '' END
  FROM de LEFT JOIN md ON md.id = de.id LEFT JOIN bc ON bc.id = de.id LEFT JOIN wx ON wx.id = de.id LEFT JOIN nt ON nt.id = de.id, sg WHERE family <> 'source'
  UNION ALL SELECT 'H3', 'primary', 'interaction method x level, random intercept by fold', (SELECT count(DISTINCT g) FROM hi), estimate, NULL, NULL, p_value, CASE WHEN estimate IS NULL THEN 'fit=none' ELSE 'fit=reml' END FROM hi_fit
  UNION ALL {_NOT_RUN}
  UNION ALL SELECT 'H10', 'secondary', 'AUPRC LOEO - LOTO', lm.n, a - b, ci_lo, ci_hi, NULL, printf('LOEO median %.3f, LOTO median %.3f', a, b) FROM lm, lc
  UNION ALL SELECT 'H11', 'secondary', 'scores of truncated and other negative reads', NULL, shift, NULL, NULL, p, printf('share of truncated reads among high false positives = %.3f', round(share, 6)) FROM tq, tf),
hs AS (SELECT id, least(1, max(1 - (1 - wilcox_p) ** (m - i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS h FROM (SELECT id, wilcox_p, count(*) OVER () AS m, row_number() OVER (ORDER BY wilcox_p NULLS LAST, id) AS i FROM al WHERE family = 'primary'))
SELECT id, family, comparison, n_folds, round(median_diff, 6) AS median_diff, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(wilcox_p, 9) AS wilcox_p, note,
       round(CASE WHEN wilcox_p IS NOT NULL THEN h END, 9) AS holm_sidak_p, CASE WHEN family = 'primary' THEN coalesce(wilcox_p IS NOT NULL AND h < 0.05, false) ELSE coalesce(ci_lo > 0 OR ci_hi < 0, false) END AS significant
FROM al LEFT JOIN hs USING (id)"""

QUERIES = {f.__name__: f for f in (study_contrasts, study_hypotheses, study_mixed_supplement, study_choice, model_run, stored_read_calls, fold_artefact, staged_run, run_inner_scores)}
ORACLES = {
    "stored_read_calls": f"""WITH {PREDICTIONS_SQL},
p AS (SELECT * FROM preds WHERE arm = 'combined' AND model = 'mixed'),
thr AS (SELECT quantile_cont(score, 0.05) AS t FROM p WHERE y = 1)
SELECT p.read_id, donor, titration_level, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN source END AS called_taxon, lang AS called_genus, species AS true_species,
       CASE WHEN y = 1 THEN 'positive' ELSE 'negative' END AS ground_truth, score AS model_score, CASE WHEN score >= t THEN 'positive' ELSE 'negative' END AS model_call,
       (y = 1) = (score >= t) AS correct
FROM p LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) ON doc_id = p.read_id, thr""",
    "fold_artefact": LABELLED_SQL + """,
pl AS (SELECT donor, fold AS p, count(*) OVER () AS n FROM don),
tx AS (SELECT species, row_number() OVER (ORDER BY species) AS f FROM (SELECT DISTINCT species FROM rw WHERE label = 'positive' AND species IS NOT NULL)),
al AS (
  SELECT 'LOEO' AS scheme, a.p AS fold, NULL AS test_species, b.donor, a.p = b.p AS t FROM pl a, pl b
  UNION ALL SELECT 'LOTO', f, species, donor, p % 2 = f % 2 OR n = 1 FROM tx, pl),
rk AS (SELECT *, row_number() OVER (w ORDER BY md5('1729|' || scheme || '|' || fold || '|' || donor), donor) AS r, count(*) OVER w AS n FROM al WINDOW w AS (PARTITION BY scheme, fold, t)),
gr AS (SELECT *, (r - 1) * least(3, n) // n + 1 AS g FROM rk),
ig AS (SELECT scheme, fold, string_agg(g || ':' || ds, ';' ORDER BY g) AS inner_groups FROM (SELECT scheme, fold, g, string_agg(donor, ',' ORDER BY donor) AS ds FROM gr WHERE NOT t GROUP BY ALL) GROUP BY ALL)
SELECT scheme, fold::INT AS fold, test_species, coalesce(string_agg(donor, ',' ORDER BY donor) FILTER (t), '') AS test_donors, coalesce(string_agg(donor, ',' ORDER BY donor) FILTER (NOT t), '') AS train_donors, coalesce(any_value(inner_groups), '') AS inner_groups
FROM gr LEFT JOIN ig USING (scheme, fold) GROUP BY scheme, fold, test_species""",
    "study_contrasts": f"WITH {STUDY_SQL}, {_DESIGN_SQL}, {_EXACT} SELECT de.id, family, comparison, coalesce(nf, 0) AS n_folds, round(md, 6) AS median_diff, round(p_value, 9) AS wilcox_p FROM de LEFT JOIN (SELECT id, count(*) AS nf, median(d) AS md FROM pr GROUP BY 1) USING (id) LEFT JOIN wx USING (id)",
    "study_hypotheses": f"WITH {STUDY_SQL}, {_DESIGN_SQL}, {_LEVELS_SQL}, {_EXACT}, {_ROWS_SQL}",
    "study_mixed_supplement": f"""WITH {STUDY_SQL}, {_DESIGN_SQL}, {_LEVELS_SQL},
mi AS (
  SELECT de.id || '|' || comparison AS id, fold AS g, auprc AS y, (ml.arm = arm_a AND ml.model = model_a)::INT::DOUBLE AS x1
  FROM ml JOIN de ON (ml.arm = arm_a AND ml.model = model_a) OR (ml.arm = arm_b AND ml.model = model_b) WHERE scheme = 'LOEO' AND de.id IN ('H1', 'H2', 'H4')), {mixed_sql("mi", 1)}
SELECT split_part(id, '|', 1) AS id, split_part(id, '|', 2) AS comparison, round(estimate, 6) AS mixed_estimate, round(p_value, 9) AS mixed_p, n AS n_units, CASE WHEN estimate IS NULL THEN 'none' ELSE 'reml' END AS engine FROM mi_fit""",
    "study_choice": f"WITH {STUDY_SQL} SELECT f AS family, t AS tree, s AS single FROM ch",
    "staged_run": """SELECT row_number() OVER (ORDER BY t.k)::INT AS fold, 'D' || t.k AS donor, n_test, n_test_pos, 'fixed' AS name, '0.9' AS min_identity, '2' AS k, 'folds,parts' AS ran
FROM (SELECT doc_id % 3 AS k, count(*) AS n_test, sum(quality)::BIGINT AS n_test_pos FROM documents JOIN labels USING (doc_id) GROUP BY 1) t""",
    # Counts of the run: donors D0 to D2 are folds 1 to 3; a taxon's fold tests the donors at odd or even places.
    "model_run": """WITH t AS (SELECT doc_id, lang, quality AS y, (doc_id % 3)::INT AS k FROM documents JOIN labels USING (doc_id)),
ds AS (SELECT k, row_number() OVER (ORDER BY k) AS fold FROM (SELECT DISTINCT k FROM t)),
runs(arm, model) AS (VALUES ('combined', 'glm'), ('length_only', 'glm'), ('combined_minus_shares', 'glm'), ('combined', 'glmm_none'), ('combined', 'glmm_truth')),
tx AS (SELECT lang AS taxon, row_number() OVER (ORDER BY lang) AS fold FROM (SELECT DISTINCT lang FROM t WHERE y = 1 AND lang IS NOT NULL AND lang <> '')),
mk AS (SELECT tx.fold, y, CASE WHEN ds.fold % 2 = tx.fold % 2 AND (y = 0 OR lang = taxon) THEN 'test' WHEN ds.fold % 2 <> tx.fold % 2 AND (y = 0 OR lang <> taxon) THEN 'train' END AS part FROM t JOIN ds USING (k), tx),
ok AS (SELECT fold FROM mk GROUP BY 1 HAVING bool_or(part = 'train' AND y = 0) AND bool_or(part = 'train' AND y = 1) AND bool_or(part = 'test' AND y = 0) AND bool_or(part = 'test' AND y = 1))
SELECT arm, model, 'LOEO' AS scheme, fold::INT AS fold, count(*) AS n, sum(y)::BIGINT AS n_pos, count(*) AS n_scored, 0 AS n_failed FROM t JOIN ds USING (k), runs GROUP BY arm, model, fold
UNION ALL SELECT 'combined', 'glm', 'LOTO', fold::INT, count(*), sum(y)::BIGINT, count(*), 0 FROM mk JOIN ok USING (fold) WHERE part = 'test' GROUP BY fold""",
}
