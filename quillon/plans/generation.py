"""Queries: the generator source, prompts, digests and catalogue functions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalogue import query, read
from quillon.functions.completions import verify
from quillon.operators import generator as G

def _sizes(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """A corpus as large as the tables: an example for every supplier, item and nation."""
    return {split: read(spark, sf_dir, name).count() for split, name in (("train", "supplier"), ("val", "benchmark"), ("test", "nation"))}


_SIZES = "(SELECT 'train' AS split, count(*) AS n FROM supplier UNION ALL SELECT 'val', count(*) FROM benchmark UNION ALL SELECT 'test', count(*) FROM nation)"


@query(f"""
SELECT split, slice, CAST(n // 6 + CASE WHEN s < n % 6 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM {_SIZES} t, (VALUES (0, 'clean'), (1, 'distractor'), (2, 'mixed_formats'), (3, 'absent_fields'), (4, 'long_context'), (5, 'many_items')) u(s, slice)
WHERE n // 6 + CASE WHEN s < n % 6 THEN 1 ELSE 0 END > 0
""")
def generated_corpus_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.generate(spark, _sizes(spark, sf_dir)).groupBy("split", "slice").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS notes, CAST(sum(n) AS BIGINT) AS valid, CAST(sum(n) AS BIGINT) AS exact FROM {_SIZES}")
def generated_corpus_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes are unique, and every gold record passes the verifier against itself."""
    rows = verify(G.generate(spark, _sizes(spark, sf_dir)), strict=True, text_col="gold", parts=["schema_valid", "exact_match"])
    return rows.agg(F.count("*").alias("n"), F.count_distinct("note").alias("notes"), F.count_if("reward.schema_valid").alias("valid"), F.count_if("reward.exact_match").alias("exact"))


def _listed(names: list[str], key: str, n: int) -> str:
    told = ", ".join("'" + x + "'" for x in names)
    return f"list_extract([{told}], CAST(('0x' || substr(md5(key || ':{key}'), 1, 8))::BIGINT % {n} AS INT) + 1)"


def _drawn(key: str, n: int) -> str:
    return f"CAST(('0x' || substr(md5(key || ':{key}'), 1, 8))::BIGINT % {n} AS INT)"


@query(f"""
WITH k AS (SELECT doc_id::VARCHAR AS key, list_extract(['clean', 'distractor', 'mixed_formats', 'absent_fields', 'long_context', 'many_items'], CAST(n_chars % 6 AS INT) + 1) AS slice FROM documents),
f AS (SELECT *, {_listed(G._FIRST, "first", 10)} || ' ' || {_listed(G._LAST, "last", 10)} AS client, ({_drawn("amount", 90)} + 5) * 1000 AS amount FROM k),
c AS (SELECT *, client || ' asks for ' || amount || ' dollars.' AS clean FROM f)
SELECT key, slice, CAST(i AS INT) AS at, CASE slice WHEN 'clean' THEN clean WHEN 'distractor' THEN clean || ' Last year it was ' || ({_drawn("before", 90)} + 5) * 1000 || '.' WHEN 'mixed_formats' THEN client || ' asks for $' || format('{{:,}}', amount) || '.'
  WHEN 'absent_fields' THEN client || ' asks for nothing.' WHEN 'long_context' THEN clean || repeat(' {G._FILLER}', {_drawn("long", 5)} + 1) ELSE clean || ' Item ' || (i + 1) || '.' END AS note
FROM c, LATERAL unnest(range(CASE WHEN slice = 'many_items' THEN {_drawn("items", 4)} + 2 ELSE 1 END)) u(i)
""")
def generated_slice_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes made by a table function from every document's id, each slice by its own maker."""
    slices = F.element_at(F.lit(G.SLICES), (F.col("n_chars") % 6 + 1).cast("int"))
    return G.slice_notes(read(spark, sf_dir, "documents").select("doc_id", slices.alias("slice")), "doc_id", "slice")


_SCHEMA = json.dumps({"type": "object", "required": ["client_name"]}, indent=2, sort_keys=True)


@query(f"""
SELECT item_id, '{G.INSTRUCTION.replace("'", "''")}' || chr(10) || chr(10) || 'JSON Schema:' || chr(10) || '{_SCHEMA}' || chr(10) || chr(10) || 'Adviser note:' || chr(10) || text || chr(10) || chr(10) || 'JSON object:' || chr(10) AS prompt
FROM benchmark
""")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", G.render_prompt(F.col("text"), _SCHEMA).alias("prompt"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%-d/%-m/%Y') AS slashed,
       CAST(day(o_orderdate) AS VARCHAR) || CASE WHEN day(o_orderdate) IN (11, 12, 13) THEN 'th' WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd' WHEN day(o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END AS nth
FROM orders
""")
def date_renderers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.functions.text import ordinal

    day = F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(day, "d/M/yyyy").alias("slashed"), ordinal(F.dayofmonth(day)).alias("nth"))


@query("SELECT conv_id, list_sort(list_distinct(list_concat(list(CAST(turn % 5 AS INT)), [2, 151645]))) AS stops FROM conversations GROUP BY conv_id")
def stop_id_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop ids of tokenizer and model together."""
    own = F.collect_set((F.col("turn") % 5).cast("int"))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.array_union(own, F.lit([2, 151645]))).alias("stops"))


@query("SELECT count(*) AS repeated FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("doc_id").count().where("count > 1").agg(F.count("*").alias("repeated"))


def chunk_ids(text: F.Column, vocab: int, width: int = 4) -> F.Column:
    """Ids of fixed-width chunks: 2 + BLAKE2b (eight bytes) mod (vocab - 2)."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        one = lambda c: 2 + int.from_bytes(hashlib.blake2b(c.encode(), digest_size=8).digest(), "big") % (vocab - 2)
        return texts.map(lambda t: [one(t[i : i + width]) for i in range(0, len(t or ""), width)])

    return run(text)


@query("SELECT item_id, CAST(ceil(length(text) / 4) AS INT) AS n_ids, TRUE AS inside FROM benchmark")
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", chunk_ids(F.col("text"), 512).alias("ids"))
    return rows.select("item_id", F.size("ids").alias("n_ids"), F.forall("ids", lambda x: x.between(2, 511)).alias("inside"))


@query("SELECT p_partkey, CAST(6 AS BIGINT) * p_size * 1000 + CAST(12 AS BIGINT) * 8 * p_size * 256 AS flops, CAST(p_size AS BIGINT) * 64 * 256 AS tokens_per_step, CAST(ceil(8.0 * p_size / 3 / 8) * 8 AS BIGINT) AS ff_dim FROM part")
def cost_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed forms of training cost over a catalogue of model sizes."""
    n = F.col("p_size").cast("long")
    return read(spark, sf_dir, "part").select("p_partkey", (6 * n * 1000 + 12 * 8 * n * 256).alias("flops"), (n * 64 * 256).alias("tokens_per_step"), (F.ceil(F.lit(8.0) * n / 3 / 8) * 8).alias("ff_dim"))
