"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.catalogue import spread

from .ann import nearest_neighbours
from .conversations import repair_conversations
from .exact_dedup import exact_dedup
from .langid import identify_languages
from .packing import pack
from .pii import find_pii
from .quality import classify_quality
from .resampling import resample
from .sampled_pieces import segmentation_digest
from .simhash import simhash_near_dedup
from .token_files import token_digest
from .toxicity import classify_toxicity
from .warc import warc_roundtrip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: File of the tokenizer that packing counts tokens with; the vocabulary itself is no part of this repository.
WORD_TOKENIZER = "word_bpe_49k.json"
#: File of the tokenizer whose ids are written to token files, and the id that ends a document there.
BYTE_TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: File of the SentencePiece model that sampled segmentations are drawn from.
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For operators that run Python: a table of fewer splits than cores is spread over them, larger ones stay as they are."""
    return spread(_read(spark, sf_dir, name))


@_query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@_query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(_spread(spark, sf_dir, "documents"))


@_query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc_roundtrip(_read(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT *, n >= 1000 AND page_id <> max(page_id) OVER w AS again, max(page_id) OVER w AS first_id FROM p WINDOW w AS (PARTITION BY html))
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM q
"""


@_query
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_spread(spark, sf_dir, "documents"), tokenizer_file(WORD_TOKENIZER))


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_spread(spark, sf_dir, "documents"))


@_query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_spread(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(_spread(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_read(spark, sf_dir, "documents"))


@_query
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_read(spark, sf_dir, "embeddings"))


@_query
def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation_digest(_spread(spark, sf_dir, "documents"), tokenizer_file(PIECE_MODEL))


@_query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(_spread(spark, sf_dir, "documents"), tokenizer_file(BYTE_TOKENIZER), END_ID)


#: A checksum as a DuckDB macro would compute it: table of the 256 remainders, and the checksum of a list of bytes.
_CRC_TABLE = "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"
_CRC = "xor(list_reduce([4294967295] || {bytes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


@_query
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_spread(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


ORACLES["op11_resample"] = f"""
WITH crc AS MATERIALIZED ({_CRC_TABLE}),
texts AS (SELECT doc_id, row_number() OVER () AS row, text, 's' AS side FROM documents UNION ALL SELECT NULL, row_number() OVER (), text, 't' FROM benchmark),
words AS MATERIALIZED (SELECT doc_id, row, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS MATERIALIZED (SELECT row, side, feature, count(*) AS n FROM (
    SELECT row, side, unnest(w) AS feature FROM words
    UNION ALL SELECT row, side, w[i] || ' ' || w[i + 1] FROM (SELECT row, side, w, unnest(range(1, len(w))) AS i FROM words)
    UNION ALL SELECT row, side, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT row, side, w, unnest(range(1, len(w) - 1)) AS i FROM words)) GROUP BY ALL),
hexed AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM runs)),
placed AS MATERIALIZED (SELECT feature, {_CRC.format(bytes="list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)")} % 10000 AS bucket FROM hexed, crc),
counts AS (SELECT bucket, sum(CASE WHEN side = 's' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 't' THEN n ELSE 0 END)::DOUBLE AS t FROM runs JOIN placed USING (feature) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM runs JOIN placed USING (feature) JOIN gains USING (bucket) WHERE side = 's' GROUP BY row),
scored AS (SELECT doc_id, row, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM words LEFT JOIN weights USING (row) WHERE side = 's'),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (row)
"""


@_query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(_read(spark, sf_dir, "conversations"))


ORACLES["op13_conversation_repair"] = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS told FROM conversations),
d AS (SELECT conv_id, turn, role, text, {_CRC.format(bytes="list_transform(string_split(told, ''), lambda x: ascii(x)::BIGINT)")} % 20 AS rule FROM c, crc),
e AS (SELECT conv_id, turn, CASE WHEN rule = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN rule = 1 THEN '' WHEN rule = 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM d, LATERAL unnest(range(CASE WHEN rule = 3 THEN 2 ELSE 1 END)) WHERE rule <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending FROM e),
f AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i,
    CASE WHEN ending = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN ending NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
ins(q, mid, k, lines) AS (VALUES (0, 0, 0, ''), (0, 2, 1, chr(10) || 'user:'), (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, ''), (1, 2, 1, chr(10) || 'user:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
    (2, 2, 0, ''), (2, 3, 1, chr(10) || 'assistant:'), (2, 2, 2, chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 0, ''), (3, 2, 1, chr(10) || 'user:'), (3, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:')),
edits(a) AS (VALUES ('D'), ('K'), ('R')),
dp AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS q, struct_pack(c := 0, a := '', t := '') AS s FROM (SELECT DISTINCT conv_id FROM f)
    UNION ALL
    SELECT conv_id, i, q, min(s) FROM (
        SELECT dp.conv_id, dp.i + 1 AS i,
            CASE a WHEN 'D' THEN mid WHEN 'R' THEN CASE WHEN mid = 2 THEN 3 ELSE 2 END ELSE CASE WHEN mid = 0 AND ini = 's' THEN 1 WHEN mid <> 2 AND ini = 'u' THEN 2 WHEN mid = 2 AND ini = 'a' THEN 3 END END AS q,
            struct_pack(c := s.c + 3 * k + CASE a WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN a <> 'D' AND fault = 't' THEN 3 ELSE 0 END, a := s.a || repeat('I', k) || a,
                t := s.t || lines || CASE a WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || CASE WHEN mid = 2 THEN 'assistant:' ELSE 'user:' END || text ELSE chr(10) || role || ':' || text END) AS s
        FROM dp JOIN ins ON ins.q = dp.q JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1, edits
        WHERE a = 'D' OR fault NOT IN ('b', 'd'))
    WHERE q IS NOT NULL GROUP BY conv_id, i, q),
last AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated FROM f GROUP BY conv_id),
best AS (SELECT dp.conv_id, min(struct_pack(c := s.c + 3 * k, a := s.a || repeat('I', k), t := s.t || lines)) AS s
    FROM dp JOIN last ON last.conv_id IS NOT DISTINCT FROM dp.conv_id AND last.n = dp.i JOIN ins ON ins.q = dp.q WHERE mid IN (0, 3) GROUP BY dp.conv_id),
ill AS (SELECT conv_id, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f) GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(s.c, 0)::BIGINT AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(substr(s.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM x.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN ill ON ill.conv_id IS NOT DISTINCT FROM x.conv_id
"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
