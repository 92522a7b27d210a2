"""Queries: classification metrics, paired comparison, the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalogue import query, read
from quillon.functions import stats
from quillon.functions.logits import argmax, folded, let, softmax
from quillon.operators import compare
from quillon.operators import evaluation as E
from quillon.operators import paired as P
from quillon.shared import table

CLASSES = list(range(10))
#: Resamples of every bootstrap.
RESAMPLES = 2000


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, probs, pred, conf: softmax over ten classes, to each of which every tenth component adds ten times its value."""
    whole = F.transform("embedding", lambda x: x.cast("double") * 10)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", let(whole, lambda v: let(folded(v, len(CLASSES)), softmax)).alias("probs"))
    return rows.withColumn("pred", argmax(F.col("probs"))).withColumn("conf", F.array_max("probs"))


_PRED = """
WITH z AS (SELECT vec_id, label, list_transform(range(10), lambda c: coalesce(list_reduce(list_transform(range(c, len(embedding), 10), lambda i: CAST(embedding[CAST(i + 1 AS INT)] AS DOUBLE) * 10), lambda a, x: a + x), 0)) AS l FROM embeddings),
e AS (SELECT vec_id, label, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM z),
p AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM e),
q AS (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS pred, list_max(probs) AS conf FROM p),
m AS (SELECT CAST(a AS INT) AS actual, CAST(b AS INT) AS predicted, count(q.vec_id) AS n FROM range(10) t(a) CROSS JOIN range(10) u(b) LEFT JOIN q ON q.label = a AND q.pred = b GROUP BY ALL),
k AS (SELECT c AS class, (SELECT n FROM m WHERE actual = c AND predicted = c) AS tp, (SELECT sum(n) FROM m WHERE actual = c) AS support, (SELECT sum(n) FROM m WHERE predicted = c) AS told FROM range(10) r(c))
"""


@query(_PRED + "SELECT * FROM m")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_predictions(spark, sf_dir), "label", "pred", CLASSES)


@query(_PRED + """
SELECT CAST(class AS INT) AS class, round(CASE WHEN told > 0 THEN tp / told ELSE 0 END, 9) AS "precision", round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 9) AS recall,
       round(CASE WHEN told + support > 0 THEN 2 * tp / (told + support) ELSE 0 END, 9) AS f1, CAST(support AS BIGINT) AS support FROM k
""")
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.class_metrics(confusion_matrix(spark, sf_dir))
    return rows.select("class", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(_PRED + """
SELECT (SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END), 9) FROM q) AS accuracy,
       round(avg(CASE WHEN told + support > 0 THEN 2 * tp / (told + support) ELSE 0 END), 9) AS macro_f1 FROM k
""")
def accuracy_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = confusion_matrix(spark, sf_dir)
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")
    return matrix.agg(F.round(right, 9).alias("accuracy")).join(E.class_metrics(matrix).agg(F.round(F.avg("f1"), 9).alias("macro_f1")))


@query(_PRED + "SELECT round(avg(-ln(greatest(least(probs[label + 1], 1), 1e-12))), 9) AS nll FROM q")
def nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).agg(F.round(E.negative_log_likelihood(F.col("probs"), F.col("label")), 9).alias("nll"))


@query(_PRED + """
SELECT round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece FROM (
  SELECT greatest(len(list_filter(list_transform(range(15), lambda i: i / 15), lambda x: x < conf)), 1) AS bin, count(*) AS n, avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END) AS acc, avg(conf) AS conf
  FROM q GROUP BY ALL)
""")
def ece_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir).withColumn("correct", F.col("pred") == F.col("label"))
    return E.calibration_error(rows, "conf", "correct").select(F.round("ece", 9).alias("ece"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, baseline (good), candidate (not toxic), difference, slice (lang)."""
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents")
    a = labels.select("doc_id", (F.col("quality") == 1).cast("int").alias("v"))
    b = labels.select("doc_id", (F.col("toxic") == 0).cast("int").alias("v"))
    return P.pair_up(a, b, "doc_id", "v").join(docs.select("doc_id", F.col("lang").alias("slice")), "doc_id")


_PAIRS = "WITH p AS (SELECT doc_id, quality AS baseline, 1 - toxic AS candidate, CAST(1 - toxic - quality AS DOUBLE) AS difference, lang AS slice FROM labels JOIN documents USING (doc_id))\n"


@query(_PAIRS + "SELECT doc_id, difference FROM p")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", "difference")


def _bools(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("baseline", F.col("baseline") == 1).withColumn("candidate", F.col("candidate") == 1)


_DISCORDANT = "count(*) FILTER (baseline = 1 AND candidate = 0) AS lost, count(*) FILTER (baseline = 0 AND candidate = 1) AS gained"


@query(_PAIRS + f"SELECT slice, {_DISCORDANT}, count(*) AS n FROM p GROUP BY slice")
def discordant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.discordant(_bools(_pairs(spark, sf_dir)), ["slice"])


@query("""
SELECT count(*) FILTER (d.doc_id IS NULL) AS unknown_labels, count(*) FILTER (l.doc_id IS NULL) AS unlabelled,
       count(*) FILTER (d.n > 1 OR l.n > 1) AS repeated
FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1) d FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id
""")
def corpus_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key checks before a paired join: keys on one side only, and repeated ones."""
    d = read(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("d"))
    both = d.join(read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("l")), "doc_id", "full_outer")
    return both.agg(F.count_if(F.isnull("d")).alias("unknown_labels"), F.count_if(F.isnull("l")).alias("unlabelled"), F.count_if((F.col("d") > 1) | (F.col("l") > 1)).alias("repeated"))


@query(_PAIRS + f"""
, c AS (SELECT slice, {_DISCORDANT} FROM p GROUP BY slice),
t AS (SELECT slice, lost, gained, list_transform(range(least(lost, gained) + 1), lambda i: gamma(lost + gained + 1.0) / gamma(i + 1.0) / gamma(lost + gained - i + 1.0)) AS terms FROM c)
SELECT slice, round(CASE WHEN lost + gained = 0 THEN 1 ELSE least(1, 2 * list_sum(terms) * pow(0.5, lost + gained)) END, 9) AS p_value FROM t
""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = P.discordant(_bools(_pairs(spark, sf_dir)), ["slice"])
    return counts.select("slice", F.round(stats.mcnemar_exact(F.col("lost"), F.col("gained")), 9).alias("p_value"))


@query(_PAIRS + f"SELECT slice, round(CASE WHEN lost + gained = 0 THEN 0 ELSE pow(abs(lost - gained) - 1, 2) / (lost + gained) END, 9) AS chi2 FROM (SELECT slice, {_DISCORDANT} FROM p GROUP BY slice)")
def mcnemar_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square with continuity correction per slice."""
    counts = P.discordant(_bools(_pairs(spark, sf_dir)), ["slice"])
    n = F.col("lost") + F.col("gained")
    return counts.select("slice", F.round(F.when(n == 0, 0.0).otherwise(F.pow(F.abs(F.col("lost") - F.col("gained")) - 1, 2) / n), 9).alias("chi2"))


#: Exact p-value of (lost, gained), and the rule: exact below 25 discordant pairs, else chi-square with correction, its tail by a series of positive terms.
_EXACT = "(CASE WHEN lost + gained = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(least(lost, gained) + 1), lambda i: exp(lgamma(lost + gained + 1.0) - lgamma(i + 1.0) - lgamma(lost + gained - i + 1.0) + (lost + gained) * ln(0.5))))) END)"
_X = "greatest(sqrt(pow(abs(lost - gained) - 1, 2) / greatest(lost + gained, 1) / 2), 1e-300)"
_TAIL = f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(200), lambda k: exp((2 * k + 1) * ln({_X}) - {_X} * {_X} + 2 * k * ln(2) + lgamma(k + 1.0) - lgamma(2 * k + 2.0)))))"
_FEW = "(CASE WHEN lost + gained = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(least(lost, gained) + 1), lambda i: round(gamma(lost + gained + 1.0) / gamma(i + 1.0) / gamma(lost + gained - i + 1.0)))) * pow(0.5, lost + gained)) END)"
_RULE = f"(CASE WHEN lost + gained < 25 THEN {_FEW} ELSE {_TAIL} END)"


@query(_PAIRS + f"SELECT slice, lost, gained, round({_RULE}, 9) AS p_value FROM (SELECT slice, {_DISCORDANT} FROM p GROUP BY slice)")
def mcnemar_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired test per slice: exact below 25 discordant pairs, else chi-square with continuity correction."""
    counts = P.discordant(_bools(_pairs(spark, sf_dir)), ["slice"])
    return counts.select("slice", "lost", "gained", F.round(stats.mcnemar_rule(F.col("lost"), F.col("gained")), 9).alias("p_value"))


_Z = "1.959963984540054"


@query(_PAIRS + f"""
, s AS (SELECT slice, sum(baseline) AS k, count(*) AS n FROM p GROUP BY slice),
i AS (SELECT slice, k / n AS p, (k / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) AS c, {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n) AS h FROM s)
SELECT slice, round(p, 9) AS point, round(least(greatest(c - h, 0), p), 9) AS low, round(greatest(least(c + h, 1), p), 9) AS high FROM i
""")
def wilson_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _pairs(spark, sf_dir).groupBy("slice").agg(F.sum("baseline").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"), stats.z_for(0.95))
    return sums.select("slice", F.round(F.col("k") / F.col("n"), 9).alias("point"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_BOOT = """
, d AS (SELECT difference AS v, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM p),
b AS (SELECT r, ('0x' || substr(md5('0:' || r || ':' || i), 1, 8))::BIGINT % (SELECT count(*) FROM p) AS idx FROM range(2000) t(r), range((SELECT count(*) FROM p)) u(i)),
m AS (SELECT r, avg(d.v) AS m FROM b JOIN d USING (idx) GROUP BY r),
ci AS (SELECT (SELECT avg(v) FROM d) AS point, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m)
"""


@query(_PAIRS + _BOOT + "SELECT round(point, 9) AS point, round(low, 9) AS low, round(high, 9) AS high FROM ci")
def bootstrap_ci_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile bootstrap of the paired difference, 2,000 resamples with drawn indices."""
    return _interval(_pairs(spark, sf_dir)).select(*(F.round(c, 9).alias(c) for c in ("point", "low", "high")))


def _interval(pairs: DataFrame) -> DataFrame:
    indexed = table(P.dense_index(pairs.select("doc_id", "difference"), "doc_id").select("idx", "difference"), "bootstrap-values")
    return P.bootstrap_interval(indexed, "difference", "idx", RESAMPLES, 0.95, 0)


_SLICES = "SELECT slice, count(*) AS n, avg(baseline) AS baseline_rate, avg(candidate) AS candidate_rate FROM p GROUP BY slice"


@query(_PAIRS + f"SELECT slice, n, round(baseline_rate, 9) AS baseline_rate, round(candidate_rate, 9) AS candidate_rate, round(candidate_rate - baseline_rate, 9) AS delta, candidate_rate - baseline_rate < -0.05 AS regressed FROM ({_SLICES})")
def slice_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.slice_deltas(_pairs(spark, sf_dir), "slice", 0.05)
    return rows.select("slice", "n", *(F.round(c, 9).alias(c) for c in ("baseline_rate", "candidate_rate", "delta")), "regressed")


_FIELDS = """
WITH f AS (SELECT source AS stem, quality = 1 AS expected, toxic = 0 AS emitted, quality = 1 AND toxic = 0 AS correct, doc_id FROM labels JOIN documents USING (doc_id)),
c AS (SELECT stem, count(*) FILTER (expected) AS expected, count(*) FILTER (emitted) AS emitted, count(*) FILTER (correct) AS correct FROM f GROUP BY stem),
c2 AS (SELECT stem, count(*) FILTER (expected) AS expected, count(*) FILTER (correct AND doc_id % 3 > 0) AS correct FROM f GROUP BY stem)
"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("stem")), "doc_id")
    return rows.select("doc_id", "stem", (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 0).alias("emitted"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("correct"))


@query(_FIELDS + "SELECT stem, expected, emitted, correct, round(CASE WHEN expected = 0 THEN 1 ELSE correct / expected END, 9) AS recall, round(CASE WHEN emitted = 0 THEN 1 ELSE correct / emitted END, 9) AS \"precision\" FROM c")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage(_fields(spark, sf_dir)).withColumn("recall", F.round("recall", 9)).withColumn("precision", F.round("precision", 9))


@query(_FIELDS + """
, r AS (SELECT stem, least(c.expected, c2.expected) AS support, CASE WHEN c.expected = 0 THEN 1 ELSE c.correct / c.expected END AS a, CASE WHEN c2.expected = 0 THEN 1 ELSE c2.correct / c2.expected END AS b FROM c JOIN c2 USING (stem))
SELECT stem, support, round(a, 9) AS baseline_recall, round(b, 9) AS candidate_recall, support >= 5 AND a - b > 0.1 AS regressed FROM r
""")
def field_recall_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fields(spark, sf_dir)
    worse = rows.withColumn("correct", F.col("correct") & (F.pmod("doc_id", F.lit(3)) > 0))
    out = P.field_deltas(E.coverage(rows), E.coverage(worse), 5, 0.1)
    return out.select("stem", "support", F.round("baseline_recall", 9).alias("baseline_recall"), F.round("candidate_recall", 9).alias("candidate_recall"), "regressed")


_WEIGHT = " + ".join(f"(u >= {c})::INT" for c in P._POISSON)


def _weighted_ci(rows: str, key: str, value: str, seed: int) -> str:
    """Common tables of a bootstrap by weights over ``rows``: ci (point, low, high)."""
    return f"""
bu AS (SELECT {value} AS v, r, ('0x' || substr(md5('{seed}:' || r || ':' || {key}), 1, 8))::BIGINT AS u FROM {rows}, range({RESAMPLES}) t(r)),
bm AS (SELECT r, sum(w * v) / sum(w) AS m FROM (SELECT r, v, {_WEIGHT} AS w FROM bu) WHERE w > 0 GROUP BY r),
ci AS (SELECT (SELECT avg({value}) FROM {rows}) AS point, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm)"""


def _mean_interval(rows: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """(point, low, high) of the mean of ``value``; rows stay where they are."""
    return P.bootstrap_metric(rows, key, lambda w: F.sum(w * F.col(value)) / F.sum(w), RESAMPLES, 0.95, seed)


@query(_FIELDS.rstrip() + ",\n" + _PAIRS.removeprefix("WITH ").rstrip() + "," + _weighted_ci("p", "doc_id", "difference", 0) + f""", s AS ({_SLICES}),
d AS (SELECT count(*) FILTER (least(c.expected, c2.expected) >= 5 AND CASE WHEN c.expected = 0 THEN 1 ELSE c.correct / c.expected END - CASE WHEN c2.expected = 0 THEN 1 ELSE c2.correct / c2.expected END > 0.1) AS fields FROM c JOIN c2 USING (stem)),
g AS (SELECT (SELECT count(*) FROM p) AS n, (SELECT avg(candidate) FROM p) AS json_rate, (SELECT avg(baseline * candidate) FROM p) AS schema_rate, (SELECT count(*) FROM s WHERE candidate_rate - baseline_rate < -0.05) AS down, (SELECT fields FROM d) AS fields, (SELECT low FROM ci) AS low),
r AS (SELECT n, json_rate < 0.8 AS a, schema_rate < 0.75 AS b, down > 0 AS c, fields > 0 AS d, NOT (low > -0.02) AS e, low FROM g)
SELECT n, CASE WHEN a OR b OR c OR d OR e THEN 'REJECT' WHEN low > 0 AND (SELECT {_EXACT} FROM (SELECT {_DISCORDANT} FROM p)) <= 0.05 THEN 'PROMOTE' ELSE 'HOLD' END AS decision,
       list_filter([CASE WHEN a THEN 'json validity below floor' END, CASE WHEN b THEN 'schema validity below floor' END, CASE WHEN c THEN 'slice regression' END, CASE WHEN d THEN 'field recall regression' END, CASE WHEN e THEN 'not non-inferior' END], lambda x: x IS NOT NULL) AS reasons
FROM r
""")
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promotion gate over the paired labels: rates, slices, fields and the interval all come from the tables."""
    pairs = table(_pairs(spark, sf_dir), "gate-pairs")  # read by each of the figures
    down = P.slice_deltas(pairs, "slice", 0.05).agg(F.count_if("regressed").alias("slices_down"))
    fields = field_recall_delta(spark, sf_dir).agg(F.count_if("regressed").alias("fields_down"))
    counts = P.discordant(_bools(pairs))
    rates = pairs.agg(F.avg("candidate").alias("json_rate"), F.avg(F.col("baseline") * F.col("candidate")).alias("schema_rate"))
    summary = counts.join(rates).join(down).join(fields).join(_mean_interval(pairs, "doc_id", "difference", 0).select("low"))  # one row each
    return P.decide(summary, stats.Floors(json=0.8, schema=0.75)).select("n", "decision", "reasons")


@query("""
WITH o AS (SELECT lang AS slice, CASE WHEN quality = 0 THEN 'unparseable' WHEN toxic = 1 THEN 'bad_enum' END AS violation, quality AS parsed, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS valid, (n_chars % 101) / 100 AS f1 FROM labels JOIN documents USING (doc_id))
SELECT CASE grouping_id(slice, violation) WHEN 3 THEN 'overall' WHEN 1 THEN 'slice' ELSE 'violation' END AS block, slice, violation, count(*) AS n, round(avg(parsed), 9) AS json_rate, round(avg(valid), 9) AS schema_rate,
       round(avg(CASE WHEN valid = 1 AND f1 >= 0.9 THEN 1 ELSE 0 END), 9) AS exact_rate, round(avg(f1), 9) AS mean_f1, round(avg(0.2 * parsed + 0.2 * valid + 0.6 * f1), 9) AS mean_reward
FROM o GROUP BY GROUPING SETS ((), (slice), (violation)) HAVING grouping_id(slice, violation) <> 2 OR violation IS NOT NULL
""")
def grouping_sets_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    parsed, f1 = F.col("quality") == 1, (F.col("n_chars") % 101) / 100
    valid = parsed & (F.col("toxic") == 0)
    violation = F.when(~parsed, "unparseable").when(F.col("toxic") == 1, "bad_enum")
    value = 0.2 * parsed.cast("double") + 0.2 * valid.cast("double") + 0.6 * f1
    out = E.metric_blocks(rows.select(F.col("lang").alias("slice"), violation.alias("violation"), parsed.alias("parsed"), valid.alias("schema_valid"), (valid & (f1 >= 0.9)).alias("exact_match"), f1.alias("field_f1"), value.alias("value")))
    return out.select("block", "slice", "violation", "n", *(F.round(c, 9).alias(c) for c in ("json_rate", "schema_rate", "exact_rate", "mean_f1", "mean_reward")))


@query("""
SELECT lang AS slice, round(avg(quality) FILTER (source IN ('src0', 'src1', 'src2', 'src3', 'src4')), 9) AS base,
       round(avg(quality) FILTER (source IN ('src5', 'src6', 'src7', 'src8', 'src9')), 9) AS tuned, round(avg(quality) FILTER (source NOT IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9')), 9) AS aligned
FROM labels JOIN documents USING (doc_id) GROUP BY lang
""")
def slice_variant_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices by variant; null where a variant has no row."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    variant = F.when(F.col("source").isin([f"src{i}" for i in range(5)]), "base").when(F.col("source").isin([f"src{i}" for i in range(5, 10)]), "tuned").otherwise("aligned")
    return rows.withColumn("variant", variant).groupBy(F.col("lang").alias("slice")).pivot("variant", ["base", "tuned", "aligned"]).agg(F.round(F.avg("quality"), 9))


_PROBES = r"""
WITH r AS (SELECT conv_id, turn, text, CASE (conv_id + turn) % 3 WHEN 0 THEN 'one_word' WHEN 1 THEN 'constraint' ELSE 'list_length' END AS kind,
  len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines FROM conversations WHERE role = 'assistant'),
o AS (SELECT *, CASE kind WHEN 'one_word' THEN words = 1 WHEN 'constraint' THEN words BETWEEN 1 AND 30 ELSE lines = 1 END AS passed,
  CASE kind WHEN 'one_word' THEN words <= 2 WHEN 'constraint' THEN words BETWEEN 1 AND 20 ELSE lines <= 2 END AS after FROM r)
"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.functions.text import list_items, word_count

    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    kind = F.element_at(F.array(F.lit("one_word"), F.lit("constraint"), F.lit("list_length")), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) + 1).cast("int"))
    rows = rows.select("conv_id", "turn", kind.alias("kind"), word_count(F.col("text")).alias("words"), F.size(list_items(F.col("text"))).alias("lines"))
    by_kind = lambda one, some, listed: F.when(F.col("kind") == "one_word", one).when(F.col("kind") == "constraint", some).otherwise(listed)
    w, n = F.col("words"), F.col("lines")
    return rows.withColumn("passed", by_kind(w == 1, w.between(1, 30), n == 1)).withColumn("after", by_kind(w <= 2, w.between(1, 20), n <= 2))


@query(_PROBES + "SELECT kind, count(*) AS n, round(avg(CASE WHEN passed THEN 1 ELSE 0 END), 9) AS pass_rate FROM o GROUP BY kind")
def probe_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probes(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("int")), 9).alias("pass_rate"))


_REPLIES = _PROBES.rstrip() + """,
f AS (SELECT conv_id, min(turn) AS first, max(turn) AS last FROM o GROUP BY conv_id),
t AS (SELECT conv_id, a.passed::INT AS before, b.passed::INT AS later, b.passed::INT - a.passed::INT AS difference FROM f JOIN (SELECT conv_id, turn AS first, passed FROM q) a USING (conv_id, first) JOIN (SELECT conv_id, turn AS last, passed FROM q) b USING (conv_id, last)),
c AS (SELECT count(*) AS n, avg(before) AS before_rate, avg(later) AS after_rate, count(*) FILTER (before = 1 AND later = 0) AS lost, count(*) FILTER (before = 0 AND later = 1) AS gained FROM t),""".replace("FROM q)", "FROM k)")
_REPLIES = _REPLIES.replace("""f AS (SELECT conv_id, min(turn)""", """k AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN words = 1 WHEN 1 THEN words BETWEEN 1 AND 30 ELSE lines = 1 END AS passed FROM r),
f AS (SELECT conv_id, min(turn)""")


@query(_REPLIES + _weighted_ci("t", "conv_id", "difference", 11) + f"""
SELECT n, round(before_rate, 9) AS before_rate, round(after_rate, 9) AS after_rate, round(greatest(0, before_rate - after_rate), 9) AS tax, round(low, 9) AS low, round(high, 9) AS high, lost, gained, round({_RULE}, 9) AS p_value,
       low > -0.05 AS non_inferior, low > 0 AS superior, high <= -0.05 AS inferior
FROM c, ci
""")
def alignment_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last reply of a conversation loses against the first on the same probe: interval, paired test and verdicts within a margin of 0.05."""
    rows = _probes(spark, sf_dir)
    w, n, kind = F.col("words"), F.col("lines"), F.pmod("conv_id", F.lit(3))
    rows = rows.select("conv_id", "turn", F.when(kind == 0, w == 1).when(kind == 1, w.between(1, 30)).otherwise(n == 1).alias("passed"))
    pairs = rows.groupBy("conv_id").agg(F.min_by("passed", "turn").alias("baseline"), F.max_by("passed", "turn").alias("candidate"))
    pairs = pairs.withColumn("difference", F.col("candidate").cast("int") - F.col("baseline").cast("int"))
    rate = lambda c: F.avg(F.col(c).cast("int"))
    sums = pairs.agg(rate("baseline").alias("before_rate"), rate("candidate").alias("after_rate"))
    both = P.discordant(pairs).join(sums).join(_mean_interval(pairs, "conv_id", "difference", 11).select("low", "high"))  # one row each
    fine, better, worse = P.verdict(F.col("low"), F.col("high"), 0.05)
    p = stats.mcnemar_rule(F.col("lost"), F.col("gained"))
    rounded = {"before_rate": F.col("before_rate"), "after_rate": F.col("after_rate"), "tax": F.greatest(F.lit(0.0), F.col("before_rate") - F.col("after_rate")), "low": F.col("low"), "high": F.col("high")}
    return both.select("n", *(F.round(c, 9).alias(k) for k, c in rounded.items()), "lost", "gained", F.round(p, 9).alias("p_value"), fine.alias("non_inferior"), better.alias("superior"), worse.alias("inferior"))


@query("""
WITH a AS (SELECT o_orderkey, o_totalprice AS v, o_orderstatus AS s FROM orders), b AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS v FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, a.v AS "left", round(b.v, 6) AS "right",
  CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'unavailable' WHEN abs(a.v - b.v) <= 1 + 0.5 * greatest(abs(a.v), abs(b.v)) THEN 'agree' WHEN coalesce(o_orderkey, l_orderkey) % 4 = 0 THEN 'explained' ELSE 'disagree' END AS status
FROM a FULL JOIN b ON o_orderkey = l_orderkey
""")
def tolerance_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to an order's price compared key by key; orders of every fourth number are known to differ."""
    told = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("price"))
    diff = compare.tolerance_diff(told, lines, ["orderkey"], "price", 0.5, 1.0, F.col("orderkey") % 4 == 0)
    return diff.select("orderkey", "left", F.round("right", 6).alias("right"), "status")
