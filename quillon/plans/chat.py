"""Queries: chats, truncation, padding, batches. Tokens here are a message's words, an id each (hash mod 1000)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalogue import query, read
from quillon.functions.draws import draw
from quillon.operators import batching as B


@query("""
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS rendered
FROM conversations GROUP BY conv_id
""")
def chatml_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chatml(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", add_generation_prompt=True)


@query("""
SELECT conv_id, turn, prompt, completion FROM (
  SELECT conv_id, turn, role, lag(role) OVER w AS before, lag(text) OVER w AS prompt, text AS completion
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'assistant' AND before = 'user'
""")
def prompt_completion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.prompt_and_answer(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, ids (of all words of every message; none: no ids), prompt_len: a fixed stand-in for an encoded chat."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(words, lambda w: draw(w, 1000).cast("int")).alias("ids"))
    return rows.withColumn("prompt_len", (F.size("ids") * F.pmod(F.col("turn") + F.col("conv_id"), F.lit(4)) / 4).cast("int"))


_IDS = r"""
WITH r AS (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> ''),
                  lambda w: CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 1000 AS INT)) AS ids FROM conversations),
i AS (SELECT conv_id, turn, ids, CAST(floor(len(ids) * ((turn + conv_id) % 4) / 4) AS INT) AS prompt_len FROM r)
"""


@query(_IDS + """
SELECT a.conv_id, a.turn, CAST(coalesce(list_position(list_transform(range(greatest(len(a.ids), len(b.ids))), lambda k: coalesce(a.ids[k + 1] = b.ids[k + 1], FALSE)), FALSE),
       greatest(len(a.ids), len(b.ids)) + 1) - 1 AS INT) AS shared
FROM i a JOIN i b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def prefix_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a turn shares with the start of the next."""
    a = _ids(spark, sf_dir)
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("next"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", B.common_prefix(F.col("ids"), F.col("next")).alias("shared"))


@query(_IDS + """
SELECT CASE WHEN len(ids) <= 16 THEN 'kept' WHEN prompt_len >= 16 THEN 'dropped' ELSE 'truncated' END AS status, count(*) AS n,
       CAST(sum(CASE WHEN len(ids) > 16 AND prompt_len >= 16 THEN 0 ELSE least(len(ids), 16) END) AS BIGINT) AS tokens
FROM i GROUP BY ALL
""")
def truncate_or_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, ids = B.truncate(F.col("ids"), F.col("prompt_len"), 16)
    rows = _ids(spark, sf_dir).select(status.alias("status"), ids.alias("cut"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.size("cut"), F.lit(0))), F.lit(0)).alias("tokens"))


_BATCHED = _IDS + """, b AS (SELECT *, (row_number() OVER (ORDER BY len(ids), conv_id, turn) - 1) // 4 AS batch FROM i),
w AS (SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch) / 8) * 8 AS INT) AS width FROM b)
"""


def _batched(ids: DataFrame) -> DataFrame:
    """All messages, shortest first, in batches of four and steps of two batches."""
    from pyspark.sql import Window

    rows = B.in_batches(ids.withColumn("length", F.size("ids")), ["length", "conv_id", "turn"], 4, 2)
    longest = F.max("length").over(Window.partitionBy("batch"))
    return rows.withColumn("width", B.padded_width(longest, 8))


@query(_BATCHED + """
SELECT conv_id, turn, width, list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0)) AS padded,
       list_concat(list_transform(range(width - len(ids)), lambda x: 0), ids) AS left_padded,
       list_concat(list_transform(range(width - len(ids)), lambda x: 0), list_transform(ids, lambda x: 1)) AS left_mask
FROM w
""")
def pad_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both paddings to the batch's width, a multiple of eight."""
    ids, width = F.col("ids"), F.col("width")
    ones = F.transform("ids", lambda x: F.lit(1))
    return _batched(_ids(spark, sf_dir)).select("conv_id", "turn", "width", B.pad_right(ids, width, 0).alias("padded"), B.pad_left(ids, width, 0).alias("left_padded"), B.pad_left(ones, width, 0).alias("left_mask"))


@query(_BATCHED + """
SELECT conv_id, turn, list_concat(list_transform(range(len(ids)), lambda k: CASE WHEN k < prompt_len THEN -100 ELSE ids[k + 1] END), list_transform(range(width - len(ids)), lambda x: -100)) AS labels,
       CAST(len(ids) - prompt_len AS INT) AS supervised
FROM w
""")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = B.masked_labels(F.col("ids"), F.col("prompt_len"), F.col("width"))
    return _batched(_ids(spark, sf_dir)).select("conv_id", "turn", labels.alias("labels")).withColumn("supervised", B.supervised(F.col("labels")))


@query(_BATCHED + "SELECT batch, count(*) AS n, max(len(ids)) AS longest, CAST(sum(width - len(ids)) AS BIGINT) AS padding FROM w GROUP BY batch")
def length_sorted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(_ids(spark, sf_dir)).groupBy("batch").agg(F.count("*").alias("n"), F.max("length").cast("long").alias("longest"), F.sum(F.col("width") - F.col("length")).alias("padding"))


@query(_BATCHED + "SELECT batch // 2 AS step, count(DISTINCT batch) AS batches, count(*) AS n FROM w GROUP BY ALL")
def accumulation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(_ids(spark, sf_dir)).groupBy("step").agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("n"))


_STOPS = "coalesce(list_position(list_transform(ids, lambda x: x % 20 = 3), TRUE), 0)"


@query(_IDS + f"SELECT conv_id, turn, CASE WHEN {_STOPS} = 0 THEN ids ELSE list_slice(ids, 1, {_STOPS} - 1) END AS kept FROM i")
def trim_at_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids before the first of a set of stop ids (here 3, 23, 43, ..)."""
    return _ids(spark, sf_dir).select("conv_id", "turn", B.until_stop(F.col("ids"), F.lit(list(range(3, 1000, 20)))).alias("kept"))


@query(_IDS + """
SELECT conv_id, turn, CAST(CASE WHEN coalesce(list_position(m, 2), 0) > 0 THEN list_position(m, 2) WHEN coalesce(list_position(m, 0), 0) > 0 THEN list_position(m, 0) - 1 ELSE len(m) END AS INT) AS answer_len
FROM (SELECT conv_id, turn, list_transform(ids, lambda x: CAST(x % 30 AS INT)) AS m FROM i)
""")
def completion_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids up to the end id 2, which counts, or the padding id 0, which does not (ids mod 30)."""
    return _ids(spark, sf_dir).select("conv_id", "turn", B.answer_length(F.transform("ids", lambda x: x % 30), 2, 0).alias("answer_len"))

