"""Training data, splits, encodings, models and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift import constants as K
from netsift.operators import learning as L
from netsift.operators import models as M
from netsift.plans import inputs
from netsift.plans.catalog import query
from netsift.plans.catalog.common import joined, r6, view
from netsift.session import run_folder
from netsift.sources import sinks

FEATURES, CATEGORICAL = K.FEATURE_ORDER, K.CATEGORICAL_FEATURES
TIME = "FLOW_START_MILLISECONDS"


def frame(spark, sf):
    return view(spark, sf, "ml_features")


@query("validate_training_frame", inputs.ansi("SELECT count(*) AS rows, true AS labels_ok, 'bad_one' AS nonfinite FROM ml_features", "ml_features"))
def validate_training_frame(spark, sf):
    rows = frame(spark, sf).withColumn("bad_one", F.when(F.col("arrival") % 50 == 0, F.lit(float("nan"))).otherwise(1.0))
    out = L.validate_training_frame(rows, [*FEATURES, "bad_one"])
    return out.withColumn("nonfinite", joined(F.col("nonfinite")))


SPLIT = {
    "sp": f"""SELECT *, CASE WHEN rn <= CAST(floor(n * (1 - 0.15 - 0.15)) AS BIGINT) THEN 'train' WHEN rn <= CAST(floor(n * (1 - 0.15)) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (ORDER BY {TIME}, flow_id) AS rn, count(*) OVER () AS n FROM ml_features)"""
}


def timed(spark, sf):
    return L.time_split(frame(spark, sf), TIME)


@query("time_split", inputs.ansi("SELECT flow_id, split FROM sp", "ml_features", extra=SPLIT))
def time_split(spark, sf):
    return timed(spark, sf).select("flow_id", "split")


@query("split_report", inputs.ansi(" UNION ALL ".join(f"SELECT split, '{d}' AS dimension, CAST({e} AS VARCHAR) AS value, count(*) AS n, min({TIME}) AS time_min, max({TIME}) AS time_max FROM sp GROUP BY ALL" for d, e in (("rows", "'all'"), ("label", "Label"), ("attack", "Attack"))), "ml_features", extra=SPLIT))
def split_report(spark, sf):
    return L.split_report(timed(spark, sf), TIME)


# Ports stand in for categories that come and go: some occur in one split only.
DRIFT = "CASE WHEN Attack = 'Bot' AND split <> 'train' THEN 'Benign' WHEN Attack = 'SQL_Injection' AND split <> 'test' THEN 'Benign' ELSE Attack END"


@query("category_diffs", inputs.ansi(
    f"""SELECT kind, value FROM (SELECT value, list(DISTINCT split) AS s FROM (SELECT {DRIFT} AS value, split FROM sp) GROUP BY value), LATERAL (VALUES ('missing_in_train', NOT list_contains(s, 'train')), ('missing_in_validation', NOT list_contains(s, 'validation')),
    ('missing_in_test', NOT list_contains(s, 'test')), ('train_only', s = ['train']), ('test_only', s = ['test'])) k(kind, yes) WHERE yes""", "ml_features", extra=SPLIT))
def category_diffs(spark, sf):
    rows = timed(spark, sf).withColumn("Attack", F.expr(DRIFT))
    return L.category_diffs(rows)


@query("stratified_split", inputs.ansi("SELECT Attack, s.split, CAST(CASE s.split WHEN 'test' THEN round(n * 0.15) WHEN 'validation' THEN round(n * 0.15) ELSE n - 2 * round(n * 0.15) END AS BIGINT) AS n FROM (SELECT Attack, count(*) AS n FROM ml_features GROUP BY Attack), (VALUES ('train'), ('validation'), ('test')) s(split)", "ml_features"))
def stratified_split(spark, sf):
    """Exact sizes per stratum; which rows fall where is fixed by the seed."""
    return L.stratified_split(frame(spark, sf), "Attack").groupBy("Attack", "split").agg(F.count("*").alias("n"))


@query("downsample_benign", inputs.ansi("SELECT Label AS label, CASE WHEN Label = 1 THEN n ELSE least(n, 2 * (SELECT count(*) FROM ml_features WHERE Label = 1)) END AS n FROM (SELECT Label, count(*) AS n FROM ml_features GROUP BY Label)", "ml_features"))
def downsample_benign(spark, sf):
    kept = L.downsample_benign(frame(spark, sf), 2.0)
    return kept.groupBy(F.col("Label").alias("label")).agg(F.count("*").alias("n"))


ENCODED = " UNION ALL ".join(f"SELECT DISTINCT '{f}' AS feature, {f} AS value FROM sp WHERE split = 'train'" for f in CATEGORICAL)


@query("fit_categorical_maps", inputs.ansi(f"SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS code FROM ({ENCODED})", "ml_features", extra=SPLIT))
def fit_categorical_maps(spark, sf):
    return L.fit_categorical_maps(timed(spark, sf).filter(F.col("split") == "train"), CATEGORICAL)


_STORED: dict[tuple[str, str, str], object] = {}


def once(spark, sf, name, make):
    """What ``make`` returns, kept for the application: models and their matrix serve several queries."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def encoded_rows(spark, sf):
    """(matrix, encoders) of the whole table, stored once: boosting reads it in every round."""

    def make():
        rows = L.stratified_split(frame(spark, sf), "Attack")
        maps = L.collect_maps(L.fit_categorical_maps(rows.filter(F.col("split") == "train"), CATEGORICAL))
        made = L.make_matrix(rows, FEATURES, maps).select("flow_id", "x", "Label", "Attack", "split")
        return sinks.settle(made, run_folder(spark, "matrix")), maps

    return once(spark, sf, "matrix", make)


def matrix(spark, sf):
    return encoded_rows(spark, sf)[0]


@query("make_matrix", inputs.ansi("SELECT flow_id, CAST(L4_DST_PORT AS DOUBLE) AS x0, CASE PROTOCOL WHEN '17' THEN 0e0 ELSE 1e0 END AS x1, CAST(IN_BYTES AS DOUBLE) AS x3, 47 AS width FROM ml_features", "ml_features"))
def make_matrix(spark, sf):
    from pyspark.ml.functions import vector_to_array

    xs = matrix(spark, sf).select("flow_id", vector_to_array("x").alias("xs"))
    return xs.select("flow_id", F.col("xs")[0].alias("x0"), F.col("xs")[1].alias("x1"), F.col("xs")[3].alias("x3"), F.size("xs").alias("width"))


FAMILY_CASE = "CASE WHEN Attack LIKE 'DDOS%' OR Attack LIKE 'DDoS%' THEN 'DDoS' WHEN Attack LIKE 'DoS%' THEN 'DoS' WHEN Attack IN ('FTP-BruteForce', 'SSH-Bruteforce') THEN 'BruteForce' WHEN Attack LIKE 'Brute_Force%' OR Attack = 'SQL_Injection' THEN 'WebAttack' WHEN Attack = 'Bot' THEN 'Bot' WHEN Attack = 'Infilteration' THEN 'Infiltration' END"


@query("attack_frame", inputs.ansi(f"SELECT flow_id, {FAMILY_CASE} AS family FROM ml_features WHERE Label = 1", "ml_features"))
def attack_frame(spark, sf):
    return L.attack_frame(frame(spark, sf)).select("flow_id", "family")


# --- metrics over stored scores ----------------------------------------------------


def stored_scores(spark, sf):
    return frame(spark, sf).select("flow_id", "Label", F.col("mock_prob").alias("prob"))


LOW = "SELECT i, 0.01e0 + i * (0.50e0 - 0.01e0) / 99 AS t FROM range(100) r(i)"
HIGH = "SELECT i, 0.70e0 + i * (0.999e0 - 0.70e0) / 119 AS t FROM range(120) r(i)"


@query("select_thresholds", inputs.ansi(
    f"""SELECT round(l.t, 6) AS low_threshold, round(coalesce(h.t, 1e0), 6) AS high_threshold, l.n AS dismissed, l.a AS dismissed_attacks, coalesce(h.n, -1) AS alerted, coalesce(h.a, -1) AS true_alerts FROM
    (SELECT i, t, count(*) FILTER (WHERE prob < t) AS n, count(*) FILTER (WHERE prob < t AND Label = 1) AS a FROM ({LOW}), (SELECT Label, mock_prob AS prob FROM ml_features) GROUP BY i, t
      HAVING count(*) FILTER (WHERE prob < t AND Label = 1) / count(*) FILTER (WHERE Label = 1) <= 0.05e0 ORDER BY i DESC LIMIT 1) l LEFT JOIN
    (SELECT i, t, count(*) FILTER (WHERE prob > t) AS n, count(*) FILTER (WHERE prob > t AND Label = 1) AS a FROM ({HIGH}), (SELECT Label, mock_prob AS prob FROM ml_features) GROUP BY i, t
      HAVING count(*) FILTER (WHERE prob > t) > 0 AND count(*) FILTER (WHERE prob > t AND Label = 1) / count(*) FILTER (WHERE prob > t) >= 0.95e0 ORDER BY i LIMIT 1) h ON true""", "ml_features"))
def select_thresholds(spark, sf):
    out = L.select_thresholds(stored_scores(spark, sf), max_leak=0.05)
    none = F.lit(-1)
    return out.select(r6(F.col("low_threshold")).alias("low_threshold"), r6(F.col("high_threshold")).alias("high_threshold"), "dismissed", "dismissed_attacks", F.coalesce("alerted", none).alias("alerted"), F.coalesce("true_alerts", none).alias("true_alerts"))


@query("routing_metrics", inputs.ansi(
    """SELECT d AS auto_dismiss_count, da AS auto_dismiss_attack_count, u AS auto_alert_count, ua AS auto_alert_true_positive_count, round(d / n, 6) AS auto_dismiss_rate, round(da / a, 6) AS auto_dismiss_attack_leak_rate, round(u / n, 6) AS auto_alert_rate,
    u - ua AS auto_alert_false_positive_count, round(ua / u, 6) AS auto_alert_precision, n - d - u AS review_count, round((n - d - u) / n, 6) AS review_rate FROM (SELECT count(*) AS n, count(*) FILTER (WHERE Label = 1) AS a, count(*) FILTER (WHERE mock_prob < 0.3e0) AS d,
    count(*) FILTER (WHERE mock_prob < 0.3e0 AND Label = 1) AS da, count(*) FILTER (WHERE mock_prob > 0.95e0) AS u, count(*) FILTER (WHERE mock_prob > 0.95e0 AND Label = 1) AS ua FROM ml_features)""", "ml_features"))
def routing_metrics(spark, sf):
    out = L.routing_metrics(stored_scores(spark, sf), 0.3, 0.95)
    return out.withColumns({c: r6(F.col(c)) for c, t in out.dtypes if t == "double"})


@query("binary_metrics", inputs.ansi(
    """SELECT round(auc, 6) AS roc_auc, round(ap, 6) AS pr_auc, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM
    (SELECT sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)) AS auc, sum(pos * (cp / (cp + cn))) / sum(pos) AS ap, CAST(coalesce(sum(pos) FILTER (WHERE p >= 0.5), 0) AS BIGINT) AS tp, CAST(coalesce(sum(neg) FILTER (WHERE p >= 0.5), 0) AS BIGINT) AS fp,
      CAST(sum(pos) - coalesce(sum(pos) FILTER (WHERE p >= 0.5), 0) AS BIGINT) AS fn, CAST(sum(neg) - coalesce(sum(neg) FILTER (WHERE p >= 0.5), 0) AS BIGINT) AS tn
      FROM (SELECT p, pos, neg, CAST(sum(pos) OVER (ORDER BY p DESC) AS DOUBLE) AS cp, CAST(sum(neg) OVER (ORDER BY p DESC) AS DOUBLE) AS cn FROM (SELECT mock_prob AS p, count(*) FILTER (WHERE Label = 1) AS pos, count(*) FILTER (WHERE Label = 0) AS neg FROM ml_features GROUP BY 1)))""", "ml_features"))
def binary_metrics(spark, sf):
    out = L.binary_metrics(stored_scores(spark, sf))
    return out.withColumns({c: r6(F.col(c)) for c, t in out.dtypes if t == "double"})


GUESS = "CASE WHEN arrival % 5 = 0 THEN 'DoS' WHEN arrival % 7 = 0 THEN 'Bot' ELSE family END"
PAIRS = {"pr": f"SELECT family, {GUESS} AS predicted FROM (SELECT *, {FAMILY_CASE} AS family FROM ml_features WHERE Label = 1)"}
PAIRS["cls"] = """SELECT c AS class, support, CASE WHEN called > 0 THEN hit / called ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r, hit FROM
  (SELECT c, count(*) FILTER (WHERE family = c) AS support, count(*) FILTER (WHERE predicted = c) AS called, count(*) FILTER (WHERE family = c AND predicted = c) AS hit FROM pr, (SELECT DISTINCT family AS c FROM pr) GROUP BY c)"""
PAIRS["clf"] = "SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM cls"


def guesses(spark, sf):
    return L.attack_frame(frame(spark, sf)).withColumn("predicted", F.expr(GUESS))


@query("multiclass_metrics", inputs.ansi(
    """SELECT class, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, support FROM clf UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM clf
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM clf
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM clf""", "ml_features", extra=PAIRS))
def multiclass_metrics(spark, sf):
    out = L.multiclass_metrics(guesses(spark, sf))
    return out.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1")})


@query("confusion_matrix", inputs.ansi("SELECT family AS actual, " + ", ".join(f"count(*) FILTER (WHERE predicted = '{f}') AS \"{f}\"" for f in K.FAMILIES) + " FROM pr GROUP BY family", "ml_features", extra=PAIRS))
def confusion_matrix(spark, sf):
    return L.confusion_matrix(guesses(spark, sf))


# --- models: trained on the given tables, so compared by rows and by their invariants -------


def version(spark, sf, kind):
    """The stored and checked version of a model, trained with the reference settings."""

    def make():
        rows, maps = encoded_rows(spark, sf)
        models = M.train_binary(rows) if kind == M.BINARY else M.train_family(family_matrix(spark, sf))
        folder = run_folder(spark, f"model-{kind}")
        M.save_version(spark, folder, kind, models, maps)
        return M.load_version(spark, folder, kind)

    return once(spark, sf, kind, make)


@query("train_binary")
def train_binary(spark, sf):
    """Trains and reports quality on the held-out split."""
    scored = M.score_binary(version(spark, sf, M.BINARY), matrix(spark, sf).filter(F.col("split") == "test"))
    return L.binary_metrics(scored)


@query("score_binary")
def score_binary(spark, sf):
    scored = M.score_binary(version(spark, sf, M.BINARY), matrix(spark, sf))
    return scored.select("flow_id", "prob", "category_hint", "category_confidence")


def family_matrix(spark, sf):
    return L.attack_frame(matrix(spark, sf).filter(F.col("Label") == 1))


@query("train_family")
def train_family(spark, sf):
    """Quality of the family boosters on held-out attack rows."""
    scored = M.score_family(version(spark, sf, M.FAMILY), family_matrix(spark, sf).filter(F.col("split") == "test"))
    return L.multiclass_metrics(scored, guess="category_hint")


@query("score_family")
def score_family(spark, sf):
    """A family for every flow that is not dismissed, whatever its label; dismissed flows are not evaluated."""
    routes = view(spark, sf, "routes").select("flow_id", "route")
    rows = matrix(spark, sf).join(routes, "flow_id").select("flow_id", "route", "x")
    alive = F.col("route") != "auto_dismiss"
    out = ["flow_id", "category_hint", "category_confidence"]
    scored = M.score_family(version(spark, sf, M.FAMILY), rows.filter(alive)).select(*out)
    return scored.unionByName(M.score_family(None, rows.filter(~alive)).select(*out))


@query("explain_scores")
def explain_scores(spark, sf):
    """Exact contributions of all features for every flow, and the five largest."""
    explained = M.explain_scores(version(spark, sf, M.BINARY), matrix(spark, sf))
    return M.with_attributions(explained, FEATURES).select("flow_id", "base", "margin", "contributions", "attributions")


RULES = ["feature_order", "feature_types", "categorical_features", "excluded_features", "categorical_encoders", "class_labels"]
KINDS = [M.BINARY, M.FAMILY]


def _values(items):
    return ", ".join(f"('{x}')" for x in items)


@query("check_contract", inputs.ansi(
    f"""SELECT k.kind, v.changed, r.rule, v.changed <> r.rule AS kept, CASE WHEN v.changed = r.rule THEN 0 WHEN r.rule = 'feature_order' THEN {len(FEATURES)} WHEN r.rule = 'feature_types' THEN {len(FEATURES)} WHEN r.rule = 'excluded_features' THEN {len(K.EXCLUDED_FEATURES)}
      WHEN r.rule = 'class_labels' THEN CASE k.kind WHEN 'binary' THEN 1 ELSE (SELECT count(DISTINCT family) FROM (SELECT {FAMILY_CASE} AS family FROM ml_features WHERE Label = 1)) END ELSE (SELECT count(DISTINCT feature) FROM ({ENCODED})) END AS entries
      FROM (VALUES {_values(KINDS)}) k(kind), (VALUES {_values(["none", *RULES])}) v(changed), (VALUES {_values(RULES)}) r(rule)""", "ml_features", extra=SPLIT))
def check_contract(spark, sf):
    """The stored metadata of both models against the six rules: as trained, and with the value of one rule emptied at a time."""
    found = []
    for kind in KINDS:
        stored = spark.read.schema("rule string, value string").json(f"{version(spark, sf, kind).folder}/metadata")
        for changed in ["none", *RULES]:
            value = F.when(F.col("rule") == changed, F.lit("{}")).otherwise(F.col("value"))
            metadata = M.read_metadata(stored.withColumn("value", value))
            kept = M.checked_rules(metadata, kind)
            found += [(kind, changed, rule, kept[rule], len(metadata[rule])) for rule in RULES]
    return spark.createDataFrame(found, "kind string, changed string, rule string, kept boolean, entries int")
