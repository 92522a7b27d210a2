"""Queries: corpus preparation, tokens, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalogue import query, read
from quillon.functions import text as T
from quillon.functions.draws import draw, seed64
from quillon.operators import bpe, corpus
from quillon.shared import shared_path
from quillon.sources import tokens

_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query(f"""
SELECT lang, count(*) AS n, min(w) AS shortest, quantile_cont(w, 0.25) AS p25, quantile_cont(w, 0.5) AS p50,
       quantile_cont(w, 0.75) AS p75, max(w) AS longest, round(avg(w), 9) AS mean
FROM (SELECT lang, len({_WORDS}) AS w FROM documents) GROUP BY lang
""")
def word_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("lang", T.word_count(F.col("text")).alias("w"))
    return corpus.length_stats(docs, "lang", F.col("w")).withColumn("mean", F.round("mean", 9))


@query("""
SELECT s.name AS label_name, count(l.doc_id) AS n
FROM (VALUES (0, 'negative'), (1, 'neutral'), (2, 'positive')) s(code, name)
LEFT JOIN labels l ON l.quality + l.toxic = s.code GROUP BY s.name
""")
def label_distribution_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(0, "negative"), (1, "neutral"), (2, "positive")], "code int, label_name string")
    counts = read(spark, sf_dir, "labels").groupBy((F.col("quality") + F.col("toxic")).alias("code")).agg(F.count("*").alias("n"))
    return names.join(counts, "code", "left").select("label_name", F.coalesce("n", F.lit(0)).alias("n"))


_SPLIT = """
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('7:' || doc_id), doc_id) AS nth,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels),
c AS (SELECT *, CAST(round_even(n * 0.2, 0) AS BIGINT) AS t, CAST(round_even(n * 0.1, 0) AS BIGINT) AS v FROM r),
s AS (SELECT doc_id, quality, CASE WHEN nth <= t THEN 'test' WHEN nth <= t + v THEN 'val' ELSE 'train' END AS split FROM c)
"""


@query(_SPLIT + "SELECT doc_id, quality, split FROM s")
def stratified_split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stratified_split(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.1, 0.2, 7)


@query(_SPLIT + "SELECT split, quality, count(*) AS n FROM s GROUP BY ALL")
def stratified_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split_assign(spark, sf_dir).groupBy("split", "quality").agg(F.count("*").alias("n"))


@query("SELECT doc_id, substr(text, 1, CAST(floor(length(text) * 0.9) AS INT)) AS train, substr(text, CAST(floor(length(text) * 0.9) AS INT) + 1) AS val FROM documents")
def contiguous_char_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.contiguous_split(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", 0.1).drop("text")


@query("""
WITH t AS (SELECT item_id, list_transform(range(length(text)), lambda i: ord(substr(text, CAST(i + 1 AS INT), 1)) % 256) AS ids FROM benchmark)
SELECT item_id, CAST(s AS INT) AS start, list_sum(list_slice(ids, s + 1, s + 16)) AS x_sum, list_sum(list_slice(ids, s + 2, s + 17)) AS y_sum
FROM t, unnest(range(greatest(len(ids) - 16, 0))) u(s)
""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 16 tokens over each item (a token: code point mod 256) with their shifted targets, as sums."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    ids = F.transform(chars, lambda c: F.expr("0") + F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int") % 256)
    rows = read(spark, sf_dir, "benchmark").select("item_id", ids.alias("ids"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("item_id", F.explode(corpus.context_windows(F.col("ids"), 16)).alias("w")).select("item_id", "w.start", total(F.col("w.x")).alias("x_sum"), total(F.col("w.y")).alias("y_sum"))


@query("""
WITH h AS (SELECT hex(encode(text)) AS h FROM benchmark), b AS (SELECT unnest(list_transform(range(0, length(h), 2), lambda i: CAST(('0x' || substr(h, i + 1, 2))::INT AS INT))) AS token FROM h)
SELECT token, count(*) AS n, CAST((SELECT count(*) FROM b) AS BIGINT) AS total FROM b GROUP BY token
""")
def token_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of all items written to flat token files, in order, and counted where they are read back."""
    path = shared_path(spark, "flat-tokens")
    rows = read(spark, sf_dir, "benchmark").select("item_id", corpus.byte_ids(F.col("text")).alias("ids"))
    total = tokens.write_tokens(rows, "ids", ["item_id"], path, 256)
    back = tokens.read_tokens(spark, path, vocab_size=256)
    return back.select(F.explode("ids").alias("token")).groupBy("token").agg(F.count("*").alias("n")).withColumn("total", F.lit(total).cast("long"))


# a mark before the last white space of a run stands in for the look ahead that DuckDB's expressions lack
@query(r"""
WITH m AS (SELECT regexp_replace(text, '(\s+)(\s)(\S)', '\1' || chr(57344) || '\2\3', 'g') AS t FROM documents),
w AS (SELECT replace(unnest(regexp_extract_all(t, ' ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+')), chr(57344), '') AS word FROM m)
SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word
""")
def pretoken_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.word_frequencies(read(spark, sf_dir, "documents"), "text")


_ASCII_WORDS = "SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents"


@query(f"""
WITH w AS (SELECT word, count(*) AS n FROM ({_ASCII_WORDS}) GROUP BY word),
p AS (SELECT unnest(list_transform(range(length(word) - 1), lambda i: struct_pack(l := ord(substr(word, CAST(i + 1 AS INT), 1)), r := ord(substr(word, CAST(i + 2 AS INT), 1))))) AS p, n FROM w WHERE length(word) > 1)
SELECT p.l AS "left", p.r AS "right", CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL
""")
def byte_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent byte pairs of ASCII words, weighted by word frequency: the statistic behind each merge."""
    words = corpus.word_frequencies(read(spark, sf_dir, "documents"), "text", "[A-Za-z]+")
    return corpus.byte_pair_counts(words)


@query()
def bpe_train_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges (rank, left, right, new_id) learned from all words of the documents."""
    model = bpe.train(read(spark, sf_dir, "documents"), "text", 320)
    return spark.createDataFrame([(i, a, b, 256 + i) for i, (a, b) in enumerate(model.merges)], "rank int, left int, right int, new_id int")


@query("SELECT item_id, TRUE AS lossless FROM benchmark")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text comes back from its ids."""
    rows = read(spark, sf_dir, "benchmark")
    model = bpe.train(rows, "text", 320)
    coded = rows.select("item_id", "text", bpe.encode(F.col("text"), model).alias("ids"))
    return coded.select("item_id", (bpe.decode(F.col("ids"), model) == F.col("text")).alias("lossless"))


@query("""
WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS b, count(*) OVER () AS k FROM (SELECT DISTINCT lang FROM documents)), n AS (SELECT count(*) AS n FROM benchmark)
SELECT lang, CAST(n // k + CASE WHEN b < n % k THEN 1 ELSE 0 END AS BIGINT) AS quota FROM l, n
""")
def even_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many examples as there are items, dealt evenly over the languages that there are, none among them, the remainder to the first."""
    from pyspark.sql import Window

    langs = read(spark, sf_dir, "documents").select("lang").distinct()  # a few rows
    at = F.row_number().over(Window.orderBy(F.asc_nulls_first("lang"))) - 1
    return langs.select("lang", corpus.even_allocation(read(spark, sf_dir, "benchmark").count(), at, max(1, langs.count())).cast("long").alias("quota"))


def _redraw_sql(rounds: int = 8) -> str:
    value = lambda a: f"('0x' || substr(md5('9:' || doc_id || ':{a}'), 1, 8))::BIGINT % (64 * (SELECT count(*) FROM documents))"
    parts = [f"s0 AS MATERIALIZED (SELECT min(doc_id) AS doc_id, 0 AS attempt, v AS value FROM (SELECT doc_id, {value(0)} AS v FROM documents) GROUP BY v)"]
    for a in range(1, rounds):
        drawn = f"SELECT doc_id, {value(a)} AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s{a - 1})"
        parts.append(f"s{a} AS MATERIALIZED (SELECT * FROM s{a - 1} UNION ALL SELECT min(doc_id), {a}, v FROM ({drawn}) WHERE v NOT IN (SELECT value FROM s{a - 1}) GROUP BY v)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, attempt, value FROM s{rounds - 1}"


@query(_redraw_sql())
def first_appearance_redraw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of its own for every document, of 64 times as many as there are documents; what is taken is drawn again."""
    docs = read(spark, sf_dir, "documents")
    pool = 64 * docs.count()
    return corpus.settle(docs, "doc_id", lambda key, attempt: draw(F.concat(F.lit("9:"), key.cast("string"), F.lit(f":{attempt}")), pool))


@query("""
SELECT doc_id, upper(substr(sha256('1:train:' || doc_id), 1, 16)) AS seed_hex FROM documents
""")
def seed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row seeds: the first eight bytes of a SHA-256, as an unsigned number and back in hexadecimal."""
    seed = seed64(F.concat(F.lit("1:train:"), F.col("doc_id").cast("string")))
    return read(spark, sf_dir, "documents").select("doc_id", F.lpad(F.conv(seed.cast("string"), 10, 16), 16, "0").alias("seed_hex"))


@query("""
SELECT lang, sha256(lang || chr(10) || string_agg(sha256(doc_id || '|' || text), chr(10) ORDER BY doc_id)) AS digest
FROM documents GROUP BY lang
""")
def split_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("|", F.col("doc_id").cast("string"), "text")
    return corpus.split_digest(read(spark, sf_dir, "documents"), "lang", "doc_id", line)


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents GROUP BY text")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the first by position."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sha")


@query("""
SELECT lang, round(avg(CASE WHEN quality IS NULL THEN 0 ELSE 1 END), 9) AS label_rate,
       round(avg(CASE WHEN text LIKE '%@%' THEN 1 ELSE 0 END), 9) AS at_rate, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""")
def field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    rate = lambda c: F.round(F.avg(c.cast("double")), 9)
    return docs.groupBy("lang").agg(rate(F.col("quality").isNotNull()).alias("label_rate"), rate(F.contains("text", F.lit("@"))).alias("at_rate"), F.count("*").alias("n"))


@query("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1, 2, 3) THEN strftime(day, '%Y-%m-%d') END AS day_text, k = 0 AS strict_ok FROM d
""")
def iso_date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six spellings of a date, two of which name no single day; only one is the strict form."""
    day = F.col("o_orderdate").cast("date")
    k = F.pmod("o_orderkey", F.lit(6))
    week_year = F.year(F.date_add(F.date_sub(day, F.weekday(day)), 3))
    week = F.concat(week_year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"), F.lit("-"), (F.weekday(day) + 1).cast("string"))
    loose = F.concat(F.lit(" "), F.concat_ws("-", F.year(day), F.month(day), F.dayofmonth(day)))
    raw = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyyMMdd")).when(k == 2, week).when(k == 3, loose).when(k == 4, F.date_format(day, "dd/MM/yyyy")).otherwise("2023-02-30")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(T.iso_day(raw), "yyyy-MM-dd").alias("day_text"), T.is_calendar_date(F.when(k == 5, "no").otherwise(raw)).alias("strict_ok"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(38,6)), 2) * 100 AS BIGINT) AS cents FROM lineitem")
def cent_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in whole cents, rounded half up through their decimal text."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.hundredths(F.col("l_extendedprice").cast("decimal(38,6)").cast("string")).alias("cents"))


def _spelled_sql(n: str) -> str:
    """``text.spell_number`` of an expression below a million."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    small = lambda x: f"list_extract({listed(T._SMALL)}, CAST({x} AS INT) + 1)"
    below_hundred = lambda x: f"CASE WHEN {x} < 20 THEN {small(x)} ELSE list_extract({listed(T._TENS)}, CAST({x} // 10 AS INT) - 1) || CASE WHEN {x} % 10 > 0 THEN '-' || {small(f'({x} % 10)')} ELSE '' END END"
    below_thousand = lambda x: f"CASE WHEN {x} < 100 THEN {below_hundred(x)} ELSE {small(f'({x} // 100)')} || ' hundred' || CASE WHEN {x} % 100 > 0 THEN ' and ' || {below_hundred(f'({x} % 100)')} ELSE '' END END"
    high, low = f"({n} // 1000)", f"({n} % 1000)"
    rest = f"CASE WHEN {low} = 0 THEN '' WHEN {low} < 100 THEN ' and ' || {below_hundred(low)} ELSE ' ' || {below_thousand(low)} END"
    return f"CASE WHEN {n} < 1000 THEN {below_thousand(n)} ELSE {below_thousand(high)} || ' thousand' || {rest} END"


@query(f"""
WITH p AS (SELECT p_partkey, p_partkey * 37 % 1000000 AS n, round(p_retailprice, 2) AS a, p_size AS s FROM part)
SELECT p_partkey, {_spelled_sql("n")} AS words, '$' || CASE WHEN a = floor(a) THEN format('{{:,}}', CAST(a AS BIGINT)) ELSE format('{{:,.2f}}', a) END AS price, s || ' basis points' AS points,
  s || CASE WHEN s % 100 BETWEEN 10 AND 13 THEN 'th' WHEN s % 10 = 1 THEN 'st' WHEN s % 10 = 2 THEN 'nd' WHEN s % 10 = 3 THEN 'rd' ELSE 'th' END AS nth
FROM p
""")
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes spelled out, dollars, basis points and ordinals."""
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", T.spell_number(F.col("p_partkey") * 37 % 1_000_000).alias("words"), T.dollars(F.round("p_retailprice", 2)).alias("price"), T.basis_points(F.col("p_size") / 100).alias("points"), T.ordinal(F.col("p_size")).alias("nth"))


@query(r"""
SELECT doc_id, replace(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')), 'ß', 'ss') AS folded FROM documents
""")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility forms, case folded, white space collapsed: the comparison key of text fields, over whole documents of any language or none.

    DuckDB has neither NFKC nor case folding; its SQL says the same for the letters that these tables hold.
    """
    return read(spark, sf_dir, "documents").select("doc_id", T.normalise_text(F.col("text")).alias("folded"))

