"""One query for each operator, with production parameters over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .binary_tokens import read_tokens, write_tokens
from .common import documents
from .exact_dedup import exact_dedup
from .fingerprints import fingerprints
from .language_id import fit, held_out, predict
from .line_dedup import line_dedup
from .mixing import mix
from .near_dedup import near_dedup
from .packing import pack
from .pii import personal_data
from .substring_dedup import substring_dedup


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), capacity=2048, end_id=0)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), percent=85, width=5)


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(documents(spark, sf_dir), end_id=1))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), window=50).drop("kept_text")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir))
    return out.select("doc_id", "source", "replica", F.round("rate", 6).alias("rate"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_fingerprints, op3_best_fit_packing, op4_minhash_near_dedup, op5_token_binary, op6_personal_data, op7_line_dedup, op8_language_id, op9_substring_dedup, op10_source_mixing)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
        "op4_minhash_near_dedup": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            sh AS (
                SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + 4], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
            both_in AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
            links AS (SELECT x, y FROM both_in JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
            ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
            reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, ways.y FROM reach r JOIN ways ON ways.x = r.b)
            SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept
            FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a""",
        "op9_substring_dedup": r"""
            WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            win AS (SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w)),
            early AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS f FROM win) WHERE f < doc_id),
            gone AS (SELECT DISTINCT doc_id, p + k AS i FROM (SELECT doc_id, p, unnest(range(50)) AS k FROM early)),
            words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
            kept AS (
                SELECT doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone.i IS NULL) AS t
                FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
            SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
        "op7_line_dedup": r"""
            WITH l AS (
                SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line
                FROM documents WHERE text IS NOT NULL),
            full_lines AS (SELECT * FROM l WHERE NOT regexp_matches(body, '^\s*$')),
            pairs AS (
                SELECT a.doc_id, a.line, a.body AS b1, b.body AS b2
                FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.line = a.line + 1),
            later AS (
                SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, line) AS k FROM full_lines)
                WHERE k > 1 AND length(body) >= 40
                UNION
                SELECT doc_id, line + d FROM (SELECT *, row_number() OVER (PARTITION BY b1, b2 ORDER BY doc_id, line) AS k FROM pairs)
                CROSS JOIN (SELECT unnest([0, 1]) AS d) WHERE k > 1),
            grown AS (
                SELECT doc_id, count(*) AS n_lines, count(r.line) AS n_removed,
                       coalesce(string_agg(body, chr(10) ORDER BY l.line) FILTER (r.line IS NULL), '') AS kept
                FROM l LEFT JOIN later r USING (doc_id, line) GROUP BY doc_id)
            SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM documents LEFT JOIN grown USING (doc_id)""",
        "op10_source_mixing": """
            WITH s AS (SELECT coalesce(source, '') AS source, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY 1),
            r AS (SELECT source, CASE WHEN chars > 0 THEN (SELECT sum(chars) FROM s) / chars::DOUBLE / (SELECT count(*) FROM s) ELSE 1.0 END AS rate FROM s),
            d AS (
                SELECT doc_id, documents.source, rate, sha256(coalesce(text, '')) AS text_sha256,
                       ('0x' || substr(md5('7/' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
                FROM documents JOIN r ON coalesce(documents.source, '') = r.source),
            c AS (
                SELECT d.*, list_sum(list_transform(range(0, 40 + 4 * ceil(rate)::INT), lambda k: exp(k * ln(rate) - rate - lgamma(k + 1)))) AS total,
                       len(list_filter(range(0, 40 + 4 * ceil(rate)::INT), lambda k:
                           list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(rate) - rate - lgamma(j + 1)))) <= u)) AS copies
                FROM d)
            SELECT doc_id, source, unnest(range(copies))::INT AS replica, round(rate, 6) AS rate, text_sha256 FROM c""",
    }
