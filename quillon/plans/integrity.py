"""Queries: joins that refuse bad keys, probes, mining counters, bootstraps of any metric, pairs for a step, the answers of a server."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalogue import query, read
from quillon.functions.completions import read_completions
from quillon.operators import batching as B
from quillon.operators import checked, paired, preferences, probes, serving

from . import chat, verification
from .preferences import _RANKED, _samples


@query("SELECT doc_id, quality, lang, source FROM labels JOIN documents USING (doc_id)")
def samples_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their documents; a label without document or a repeated document would be an error."""
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents")
    return checked.matched(labels.select("doc_id", "quality"), docs.select("doc_id", "lang", "source"), "doc_id")


@query(verification._KNOWN + "SELECT c_custkey, slice, strict AS strict_parsed, lenient AS lenient_parsed, strict AND valid AS strict_valid, valid AS lenient_valid FROM o")
def one_to_one_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions joined one to one with their gold, read by both parsers."""
    rows = verification.completions(spark, sf_dir)
    joined = checked.one_to_one(rows.select("c_custkey", "text"), rows.select("c_custkey", "slice", "gold"), "c_custkey")
    found = read_completions(joined).select("c_custkey", "slice", "reading.*")
    clean = F.size("violations") == 0
    return found.select("c_custkey", "slice", F.col("strict").alias("strict_parsed"), F.col("lenient").alias("lenient_parsed"), (F.col("strict") & clean).alias("strict_valid"), clean.alias("lenient_valid"))


@query("""
WITH r AS (SELECT lang, avg(quality) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY lang),
p AS (SELECT * FROM (VALUES (0, 'en', 'de'), (1, 'de', 'fr'), (2, 'en', 'fr')) t(place, baseline, candidate))
SELECT place, baseline, candidate, round(b.rate - a.rate, 9) AS difference FROM p JOIN r a ON a.lang = baseline JOIN r b ON b.lang = candidate
""")
def variant_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed list of pairs of variants (here languages) compared by their rates."""
    rates = samples_matched(spark, sf_dir).groupBy("lang").agg(F.avg("quality").alias("rate"))
    out = checked.compared(rates, "lang", "rate", [("en", "de"), ("de", "fr"), ("en", "fr")])
    return out.withColumn("difference", F.round("difference", 9))


_FAMILIES = r"""
WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS text, list_extract(['word_metal', 'word_sum', 'word_animal', 'word_month', 'rule_true_false', 'rule_opening', 'rule_short', 'rule_no_a', 'rule_echo', 'list_trees', 'list_rivers', 'list_tools'], CAST(conv_id % 12 AS INT) + 1) AS probe_id FROM conversations WHERE role = 'assistant'),
m AS (SELECT *, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\s]', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS bare, regexp_replace(text, '^\s+|\s+$', '', 'g') AS whole,
  len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines FROM r),
o AS (SELECT *, CASE WHEN probe_id LIKE 'word%' THEN len(list_filter(string_split_regex(bare, '\s+'), lambda w: w <> '')) = 1 WHEN probe_id = 'rule_true_false' THEN lower(bare) IN ('true', 'false')
  WHEN probe_id = 'rule_opening' THEN starts_with(lower(whole), 'since') AND words <= 25 WHEN probe_id = 'rule_short' THEN words BETWEEN 1 AND 6 WHEN probe_id = 'rule_no_a' THEN whole <> '' AND NOT contains(lower(text), 'a')
  WHEN probe_id = 'rule_echo' THEN whole = '17' WHEN probe_id = 'list_trees' THEN lines = 4 WHEN probe_id = 'list_rivers' THEN lines = 3 ELSE lines = 2 END AS passed FROM m)
"""


#: The same of documents, of which even the smallest tables have some for every probe.
_ANSWERED = _FAMILIES.replace("SELECT conv_id, turn, ", "SELECT doc_id, ").replace("conv_id % 12", "doc_id % 12").replace("FROM conversations WHERE role = 'assistant'", "FROM documents")


def _replies(rows: DataFrame, key: str) -> DataFrame:
    """Texts as replies to the twelve probes, dealt out by ``key``."""
    names = F.array(*(F.lit(p[0]) for p in probes.PROBES))
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), F.element_at(names, (F.pmod(key, F.lit(12)) + 1).cast("int")).alias("probe_id"))


@query(_FAMILIES + "SELECT probe_id, count(*) AS n, count(*) FILTER (passed) AS passed FROM o GROUP BY probe_id")
def probe_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that satisfy each of the twelve probes, over seven families of predicates."""
    replies = _replies(read(spark, sf_dir, "conversations").where("role = 'assistant'"), "conv_id")
    rows = replies.withColumn("ok", probes.passed(F.col("text"), F.col("probe_id")))
    return rows.groupBy("probe_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"))


@query(_ANSWERED + ", f AS (SELECT probe_id, min(text) AS text FROM r GROUP BY probe_id) SELECT DISTINCT o.probe_id, CASE split_part(o.probe_id, '_', 1) WHEN 'word' THEN 'one_word' WHEN 'rule' THEN 'constraint' ELSE 'list_length' END AS kind, passed FROM o JOIN f USING (probe_id, text)")
def probe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply to every probe, joined key-complete."""
    return probes.score_probes(_replies(read(spark, sf_dir, "documents"), "doc_id").groupBy("probe_id").agg(F.min("text").alias("text")))


_COUNTERS = """count(*) AS prompts, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(pairs) AS BIGINT) AS pairs,
  count(*) FILTER (outcome = 'paired') AS paired, count(*) FILTER (outcome = 'single_sample') AS single_sample, count(*) FILTER (outcome = 'saturated') AS saturated,
  count(*) FILTER (outcome = 'flat') AS flat, count(*) FILTER (outcome = 'no_pair') AS no_pair, round(sum(margin) / nullif(sum(pairs), 0), 9) AS mean_margin,
  round(sum(pairs) / count(*), 9) AS pair_yield, round(count(*) FILTER (outcome = 'paired') / count(*), 9) AS prompt_yield, round(count(*) FILTER (outcome = 'saturated') / count(*), 9) AS saturation_rate
FROM o JOIN (SELECT example_id, count(*) AS n FROM s GROUP BY 1) USING (example_id) LEFT JOIN (SELECT example_id, sum(margin) AS margin FROM k GROUP BY 1) USING (example_id)"""
_RATES = ["mean_margin", "pair_yield", "prompt_yield", "saturation_rate"]


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.round(c, 9).alias(c) if c in _RATES else c for c in rows.columns))


@query(_RANKED + "SELECT " + _COUNTERS)
def mining_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    return _rounded(preferences.mining_report(samples, preferences.mine_pairs(samples, 3)))


@query(_RANKED + "SELECT coalesce(nullif(regexp_extract(example_id, '-(.*)$', 1), ''), 'none') AS slice, " + _COUNTERS + " GROUP BY 1")
def mining_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    slice_ = F.regexp_extract("example_id", "-(.*)$", 1)
    samples = _samples(spark, sf_dir).withColumn("slice", F.when(slice_ == "", "none").otherwise(slice_))
    pairs = preferences.mine_pairs(samples.drop("slice"), 3)
    return _rounded(preferences.mining_report(samples, pairs, "slice"))


_WEIGHT = " + ".join(f"(u >= {c})::INT" for c in paired._POISSON)


@query(f"""
WITH d AS (SELECT quality, b, ('0x' || substr(md5('5:' || b || ':' || doc_id), 1, 8))::BIGINT AS u FROM labels, range(1000) t(b)),
w AS (SELECT b, quality, {_WEIGHT} AS w FROM d), m AS (SELECT b, sum(w * quality) / sum(w) AS m FROM w WHERE w > 0 GROUP BY b)
SELECT round((SELECT avg(quality) FROM labels), 9) AS point, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m
""")
def bootstrap_any_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile bootstrap of 1,000 resamples of a weighted rate; rows stay where they are."""
    rate = lambda w: F.sum(w * F.col("quality")) / F.sum(F.when(F.col("quality").isNotNull(), w))
    out = paired.bootstrap_metric(read(spark, sf_dir, "labels"), "doc_id", rate, 1000, 0.95, 5)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(chat._IDS + "SELECT conv_id, sha256(string_agg(sha256(len(ids) || ':' || array_to_string(ids, ',')), '' ORDER BY turn)) AS digest FROM i GROUP BY conv_id")
def sequences_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sequences_digest(chat._ids(spark, sf_dir), "conv_id", ["turn"], "ids")


_PAIRS = chat._IDS + """
, q AS (SELECT conv_id, turn, conv_id % 5 AS batch, ids, prompt_len, len(ids) AS n, CASE WHEN len(ids) <= 48 THEN 'kept' WHEN prompt_len >= 48 THEN 'dropped' ELSE 'truncated' END AS status FROM i)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message as chosen, the same with its answer part turned round as rejected."""
    rows = chat._ids(spark, sf_dir)
    p = F.col("prompt_len")
    turned = F.concat(F.slice("ids", F.lit(1), p), F.reverse(F.slice("ids", p + 1, F.size("ids"))))
    return rows.select("conv_id", "turn", F.pmod("conv_id", F.lit(5)).alias("batch"), F.col("ids").alias("chosen"), turned.alias("rejected"), "prompt_len")


@query(_PAIRS + """
SELECT conv_id, turn, batch, CAST(ceil(max(least(n, 48)) OVER (PARTITION BY batch) / 8) * 8 AS INT) AS width, status = 'truncated' AS truncated,
       CAST(least(n, 48) - prompt_len AS INT) AS supervised, CAST(list_sum(list_slice(ids, 1, 48)) AS BIGINT) AS id_sum FROM q WHERE status <> 'dropped'
""")
def pair_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of every surviving pair in one width a batch, rounded up to a multiple of eight."""
    rows = B.collate_pairs(_pairs(spark, sf_dir), 48, 0, 8)
    total = F.aggregate("chosen_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    supervised = B.supervised(F.col("rejected_labels"))
    return rows.select("conv_id", "turn", "batch", "width", "truncated", supervised.alias("supervised"), F.when(supervised + F.col("prompt_len") > 0, total).alias("id_sum"))


@query(_PAIRS + "SELECT batch, count(*) AS pairs, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'truncated') AS truncated, count(*) FILTER (status = 'dropped') AS dropped FROM q GROUP BY batch")
def pair_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.survival(_pairs(spark, sf_dir), 48)


@query(chat._IDS + """
, q AS (SELECT conv_id, turn, ids, len(ids) AS prompt_tokens, CAST((turn % 3) * 20 AS INT) AS most_new FROM i),
e AS (SELECT *, CASE WHEN prompt_tokens + most_new <= 120 AND most_new > 0 THEN 'ok' ELSE 'too_long' END AS status, coalesce(list_position(ids, 7), 0) AS stop_at FROM q)
SELECT conv_id, turn, status, CASE WHEN stop_at BETWEEN 1 AND most_new THEN 'stop' ELSE 'length' END AS finish_reason,
       CAST(CASE WHEN stop_at BETWEEN 1 AND most_new THEN stop_at - 1 ELSE least(prompt_tokens, most_new) END AS INT) AS completion_tokens FROM e
""")
def admission_and_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context check, and how each answer ended: at the end id (7) or at its own limit."""
    rows = chat._ids(spark, sf_dir).withColumn("prompt_tokens", F.size("ids")).withColumn("most_new", (F.pmod("turn", F.lit(3)) * 20).cast("int"))
    return serving.finished(serving.admitted(rows, 120), "ids", 7).select("conv_id", "turn", "status", "finish_reason", "completion_tokens")


@query("""
WITH q AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN 'lost device' END AS error, CAST(turn AS DOUBLE) AS started, turn + (conv_id % 7) / 4 AS ended FROM conversations)
SELECT conv_id, turn, CASE WHEN min(error) OVER w IS NULL THEN 'done' ELSE 'failed' END AS status, min(error) OVER w AS reason, round(max(ended) OVER w - min(started) OVER w, 9) AS latency_s
FROM q WINDOW w AS (PARTITION BY conv_id)
""")
def settled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One failing member fails its batch (here a conversation); all members share the latency."""
    rows = read(spark, sf_dir, "conversations")
    error = F.when((F.pmod("conv_id", F.lit(9)) == 4) & (F.col("turn") == 1), "lost device")
    rows = rows.select("conv_id", "turn", error.alias("error"), F.col("turn").cast("double").alias("started"), (F.col("turn") + F.pmod("conv_id", F.lit(7)) / 4).alias("ended"))
    return serving.settled(rows, ["conv_id"], "error", "started", "ended").select("conv_id", "turn", "status", "reason", F.round("latency_s", 9).alias("latency_s"))
