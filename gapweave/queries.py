"""One query for each operator, over the driver's tables, and DuckDB SQL that predicts the same rows.

Conversations and documents are rendered as Markdown and parsed by the engine; as their structure is known, plain SQL
tells blocks, ranges and segments without a parser. Embeddings in sequences of 50 stand for a document's vectors.
Whole numbers are longs on both sides, and sums of floats are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import text as T
from .operators import blocks as B, detect as D, embed, evaluate as E, gaps as G, links as L, quality as Q, render as R, segments as S
from .operators.markdown import parse
from .sources import tables
from .sources.llm_detector import INSTRUCTIONS, prompts
from .sources.providers import ProviderConfig, create, keyed, with_cache
from .streaming import incremental as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
#: Parameters of the queries, the same in both engines.
FIXED, MIN_TOKENS, MAX_TOKENS, OVERLAP = 3, 60, 150, 4


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with whole numbers as longs and floats rounded."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = function(spark, sf_dir)
            kinds = {"int": lambda c: F.col(c).cast("long"), "double": lambda c: F.round(F.col(c), DIGITS)}
            return df.select(*[kinds.get(t, F.col)(c).alias(c) for c, t in df.dtypes])

        QUERIES[function.__name__] = run
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def joined(path: str = "heading_path") -> Column:
    return F.array_join(path, " > ").alias("path")


def conv_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.blocks_of(tables.conversations(spark, sf_dir))


def by_headings(blocks: DataFrame) -> DataFrame:
    return S.optimize(blocks, D.HeadingSplit().detect(blocks))


def conv_segments(spark: SparkSession, sf_dir: str, linked: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sources, assigned blocks, segments with ids and names."""
    sources = (tables.linked_conversations if linked else tables.conversations)(spark, sf_dir)
    assigned = by_headings(B.blocks_of(sources))
    return sources, assigned, R.with_filenames(S.with_ids(S.roll_up(assigned), sources), assigned)


# What SQL knows of the rendered tables: blocks with block_idx, kind, heading_level, text, raw, range, tokens, path.
TOKENS = "coalesce(ceil(octet_length(encode(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g'))) / 4.0::DOUBLE + (octet_length(encode({0})) - octet_length(encode(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')))) / 3.0::DOUBLE), 0)::BIGINT"
SPLIT = "unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k"
CONV = f"""
turns AS (SELECT conv_id AS doc_id, turn, role, text FROM conversations),
parts AS (
    SELECT DISTINCT doc_id, -1 AS turn, 0 AS k, 'heading' AS kind, 1 AS heading_level, 'Conversation ' || doc_id AS text, '' AS path FROM turns
    UNION ALL SELECT doc_id, turn, 0, 'heading', 2, turn || ' ' || role, 'Conversation ' || doc_id FROM turns
    UNION ALL SELECT doc_id, turn, k, 'paragraph', 0, text, 'Conversation ' || doc_id || ' > ' || turn || ' ' || role FROM (SELECT doc_id, turn, role, {SPLIT} FROM turns)),
sized AS (SELECT *, CASE WHEN kind = 'heading' THEN repeat('#', heading_level) || ' ' ELSE '' END || text || chr(10) || chr(10) AS raw FROM parts),
blocks AS (
    SELECT doc_id, turn, kind, heading_level::BIGINT AS heading_level, text, path, raw, {TOKENS.format('text')} AS tokens, 3 AS lines,
           row_number() OVER w - 1 AS block_idx, (sum(octet_length(encode(raw))) OVER w)::BIGINT AS end_byte,
           (sum(octet_length(encode(raw))) OVER w - octet_length(encode(raw)))::BIGINT AS start_byte
    FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY turn, k)),
segs AS (
    SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS seg_idx, turn, min(block_idx) AS first_block, max(block_idx) AS last_block,
           min_by(path, block_idx) AS path, min_by(text, block_idx) AS title, min(start_byte) AS start_byte, max(end_byte) AS end_byte,
           sum(tokens)::BIGINT AS token_count, sum(lines)::BIGINT AS line_count, count(*) AS block_count, string_agg(raw, '' ORDER BY block_idx) AS raw
    FROM blocks GROUP BY doc_id, turn),
ids AS (
    SELECT *, 'conversation-' || doc_id || '.md' AS source_name,
           sha256('conversation-' || doc_id || '.md:' || start_byte || ':' || end_byte || ':' || raw) AS segment_id,
           lpad((seg_idx + 1)::VARCHAR, greatest(2, length((count(*) OVER (PARTITION BY doc_id))::VARCHAR))::INT, '0') || '-' || replace(lower(title), ' ', '-') || '.md' AS filename,
           CASE WHEN path = '' THEN '' ELSE '<!-- context: ' || path || ' -->' || chr(10) || chr(10) END || raw AS rendered
    FROM segs)"""
DOCS = f"""
parts AS (
    SELECT doc_id, 0 AS g, 0 AS k, 'heading' AS kind, 1 AS heading_level, source AS text, '' AS path FROM documents
    UNION ALL SELECT doc_id, 1, 0, 'heading', 2, 'doc ' || doc_id, source FROM documents
    UNION ALL SELECT doc_id, 2, k, 'paragraph', 0, text, source || ' > doc ' || doc_id FROM (SELECT doc_id, source, {SPLIT} FROM documents)),
sized AS (SELECT *, CASE WHEN kind = 'heading' THEN repeat('#', heading_level) || ' ' ELSE '' END || text || chr(10) || chr(10) AS raw FROM parts),
blocks AS (
    SELECT doc_id, kind, heading_level::BIGINT AS heading_level, text, path, row_number() OVER w - 1 AS block_idx,
           (sum(octet_length(encode(raw))) OVER w)::BIGINT AS end_byte, (sum(octet_length(encode(raw))) OVER w - octet_length(encode(raw)))::BIGINT AS start_byte
    FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY g, k))"""
FLAT = f"flat AS (SELECT doc_id, text, k - 1 AS block_idx FROM (SELECT doc_id, {SPLIT} FROM documents))"
EMB = """
seq AS (SELECT vec_id // 50 AS doc_id, vec_id % 50 AS block_idx, embedding::DOUBLE[] AS vector, label FROM embeddings),
gaps AS (
    SELECT doc_id, block_idx AS gap_idx, list_cosine_similarity(vector, lead(vector) OVER w) AS similarity, lead(block_idx) OVER w AS nxt
    FROM seq WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)),
sims AS (SELECT doc_id, gap_idx, similarity FROM gaps WHERE nxt IS NOT NULL),
steps AS (
    SELECT *, coalesce(similarity > lag(similarity) OVER w, false)::INT AS up, coalesce(similarity < lag(similarity) OVER w, false)::INT AS down
    FROM sims WINDOW w AS (PARTITION BY doc_id ORDER BY gap_idx)),
runs AS (SELECT *, sum(up) OVER w AS ru, sum(down) OVER w AS rd FROM steps WINDOW w AS (PARTITION BY doc_id ORDER BY gap_idx)),
depths AS (
    SELECT doc_id, gap_idx, similarity, max(similarity) OVER (PARTITION BY doc_id, ru) + max(similarity) OVER (PARTITION BY doc_id, rd) - 2 * similarity AS depth FROM runs),
scored AS (
    SELECT *, avg(depth) OVER (PARTITION BY doc_id) - stddev_pop(depth) OVER (PARTITION BY doc_id) / 2 AS threshold, max(depth) OVER (PARTITION BY doc_id) AS top FROM depths),
sure AS (SELECT *, CASE WHEN top > 0 THEN greatest(0, least(1, (depth - threshold) / top)) ELSE 0 END AS confidence FROM scored)"""
FIXED_SEGS = f"fixed AS (SELECT *, block_idx // {FIXED} AS seg_idx FROM blocks)"


@query(f"WITH {CONV} SELECT doc_id, seg_idx, path, start_byte, end_byte, token_count, line_count, block_count FROM segs")
def conversation_segments(spark, sf_dir):
    """Heading split, snapping and roll-up (D3, W8, W11, A1): segments per conversation with token totals."""
    s = S.roll_up(by_headings(conv_blocks(spark, sf_dir)))
    return s.select("doc_id", "seg_idx", joined(), "start_byte", "end_byte", "token_count", "line_count", "block_count")


@query(f"WITH {CONV} SELECT doc_id, block_idx, kind, heading_level, text, start_byte, end_byte FROM blocks")
def parse_blocks(spark, sf_dir):
    """S1-S6 over conversations."""
    return parse(tables.conversations(spark, sf_dir)).select("doc_id", "block_idx", "kind", "heading_level", "text", "start_byte", "end_byte")


@query(f"WITH {DOCS} SELECT doc_id, block_idx, kind, heading_level, text, path, start_byte, end_byte FROM blocks")
def parse_documents(spark, sf_dir):
    """S2-S6 and W1 over documents with non-ASCII text."""
    return B.with_heading_path(parse(tables.documents(spark, sf_dir), guarded=True)).select("doc_id", "block_idx", "kind", "heading_level", "text", joined(), "start_byte", "end_byte")


@query("""
SELECT o_custkey AS doc_id, 1 + count(DISTINCT o_orderkey) AS headings, count(DISTINCT o_orderkey) AS lists, count(*) AS items
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def parse_orders(spark, sf_dir):
    """List blocks, one for each order's lineitems."""
    b = parse(tables.orders(spark, sf_dir))
    return b.groupBy("doc_id").agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "list").alias("lists"), F.sum(F.when(F.col("kind") == "list", F.size(F.split("text", "\n"))).otherwise(0)).alias("items"))


@query(f"WITH {CONV} SELECT doc_id, block_idx, path FROM blocks")
def heading_path(spark, sf_dir):
    """W1."""
    return conv_blocks(spark, sf_dir).select("doc_id", "block_idx", joined())


@query(f"WITH {CONV} SELECT doc_id, count(*) AS n_blocks, sum(octet_length(encode(raw)))::BIGINT AS covered, 0::BIGINT AS violations FROM blocks GROUP BY doc_id")
def tile_check(spark, sf_dir):
    """Blocks tile their source."""
    sources = tables.conversations(spark, sf_dir)
    b = parse(sources)
    wrong = Q.tiling_violations(b, sources, "block_idx").groupBy("doc_id").agg(F.count(F.lit(1)).alias("violations"))
    return b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("covered")).join(wrong, "doc_id", "left").fillna(0, ["violations"])


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    """F1."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents")
def line_estimate(spark, sf_dir):
    """F2."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", T.line_estimate(F.col("text").cast("binary")).alias("lines"))


@query("SELECT doc_id, sha256(encode(text)[11:60]) AS slice_sha256 FROM documents")
def byte_slice(spark, sf_dir):
    """bytes 10 to 60 of each text, hashed."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.slice_bytes(F.col("text").cast("binary"), F.lit(10), F.lit(60)), 256).alias("slice_sha256"))


@query(r"SELECT doc_id, lower(trim(regexp_replace(nfc_normalize(text), '[\s\x{85}\p{Z}]+', ' ', 'g'))) AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    """NFC, white space, case."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text"), T.NormalizeConfig(lower=True)).alias("normalized"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '`([^`]+)`', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'),
    '(?m)^#{1,6}[ \t]+(.+)$', '\1', 'g'), '(?m)^[-*_]{3,}[ \t]*$', '', 'g'), '(?m)^>[ \t]*', '', 'g'), '(?m)^[ \t]*(?:[-*+]|\d+\.)[ \t]+', '', 'g'), '<[^>]+>', '', 'g')) AS stripped_sha256
FROM documents""")
def strip_markdown(spark, sf_dir):
    """F5 over texts with symbol runs."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.strip_markdown(F.col("text")), 256).alias("stripped_sha256"))


@query(r"""
SELECT doc_id, rtrim(left(trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^[\s\x{85}\p{Z}]+', ''), '[\s\x{85}\p{Z}]+$', ''),
    '[^a-zA-Z0-9 \p{P}\p{S}]', '', 'g'), '[ \p{P}\p{S}]+', '-', 'g')), '-'), 50), '-') AS slug
FROM documents""")
def slugify(spark, sf_dir):
    """F11."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(f"WITH {CONV} SELECT doc_id, seg_idx, filename FROM ids")
def filenames(spark, sf_dir):
    """F12, F13."""
    return conv_segments(spark, sf_dir)[2].select("doc_id", "seg_idx", "filename")


@query("SELECT doc_id, k AS seg_idx, lpad((k + 1)::VARCHAR, greatest(2, length(n::VARCHAR))::INT, '0') || '-' || slug || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END || '.md' AS filename FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id, slug ORDER BY k) AS nth FROM (SELECT conv_id AS doc_id, role AS slug, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations))")
def filenames_repeated(spark, sf_dir):
    """F13 with repeated slugs: turns named by role alone."""
    order = Window.partitionBy("doc_id").orderBy("turn")
    t = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role").withColumn("seg_idx", (F.row_number().over(order) - 1).cast("int"))
    assigned = t.select("doc_id", "seg_idx", F.col("seg_idx").alias("block_idx"), F.lit("heading").alias("kind"), F.col("role").alias("text"))
    return R.with_filenames(t.select("doc_id", "seg_idx", F.array().cast("array<string>").alias("heading_path")), assigned).select("doc_id", "seg_idx", "filename")


def _context(style: str, **kw) -> Query:
    return lambda spark, sf_dir: conv_blocks(spark, sf_dir).select("doc_id", "block_idx", T.context_header(F.col("heading_path"), style, **kw).alias("header"))


@query(f"WITH {CONV} SELECT doc_id, block_idx, CASE WHEN path = '' THEN '' ELSE '<!-- context: ' || path || ' -->' || chr(10) || chr(10) END AS header FROM blocks")
def context_comment(spark, sf_dir):
    """F9."""
    return _context("comment")(spark, sf_dir)


@query(f"WITH {CONV} SELECT doc_id, block_idx, CASE WHEN path = '' THEN '' ELSE '---' || chr(10) || 'context:' || chr(10) || '  - ' || replace(path, ' > ', chr(10) || '  - ') || chr(10) || '---' || chr(10) || chr(10) END AS header FROM blocks")
def context_front_matter(spark, sf_dir):
    """F9."""
    return _context("front-matter")(spark, sf_dir)


@query(f"WITH {CONV} SELECT doc_id, block_idx, CASE WHEN path = '' THEN '' ELSE '# ' || replace(path, ' > ', chr(10) || chr(10) || '## ') || chr(10) || chr(10) END AS header FROM blocks")
def context_heading(spark, sf_dir):
    """F9."""
    return _context("heading")(spark, sf_dir)


@query(f"WITH {CONV} SELECT doc_id, block_idx, CASE WHEN NOT contains(path, ' > ') OR contains(split_part(path, ' > ', 2), 'assistant') THEN '' ELSE '<!-- context: ' || split_part(path, ' > ', 2) || ' -->' || chr(10) || chr(10) END AS header FROM blocks")
def context_filtered(spark, sf_dir):
    """without entries that name the conversation or the assistant, at most one deep."""
    return _context("comment", exclude=("Conversation", "assistant"), max_depth=1)(spark, sf_dir)


PSEUDO = T.PseudoHeadingConfig(prefixes=("^The ", "["), exclude=("with",))


@query(rf"""
WITH {FLAT}, hits AS (SELECT *, regexp_matches(text, '^The ') AND NOT contains(text, 'with') AS hit FROM flat)
SELECT doc_id, block_idx, CASE WHEN hit THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN hit THEN 7 ELSE 0 END::BIGINT AS heading_level,
       CASE WHEN hit THEN '' ELSE coalesce(last_value(CASE WHEN hit THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_idx), '') END AS path
FROM hits""")
def pseudo_heading(spark, sf_dir):
    """Promoted paragraphs and rebuilt paths; a pattern that does not compile is skipped."""
    b = parse(tables.flat_documents(spark, sf_dir), guarded=True)
    return B.detect_pseudo_headings(b, PSEUDO).select("doc_id", "block_idx", "kind", "heading_level", joined())


RUNS = rf"""
WITH {FLAT}, l AS (SELECT *, {{hit}} AS hit FROM flat),
m AS (SELECT *, (hit OR coalesce(lag(hit) OVER w, true))::INT AS fresh, (sum(octet_length(encode(text)) + 1) OVER w)::BIGINT AS upto FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY block_idx) AS run FROM m),
g AS (SELECT doc_id, run, string_agg(text, chr(10) ORDER BY block_idx) AS text, min(upto - octet_length(encode(text)) - 1)::BIGINT AS start_byte, max(upto) AS upto FROM r GROUP BY doc_id, run)
SELECT doc_id, row_number() OVER w - 1 AS block_idx, text, start_byte, CASE WHEN lead(run) OVER w IS NULL THEN upto - 1 ELSE upto END AS end_byte FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY run)"""


@query(RUNS.format(hit="true"))
def split_long_paragraphs(spark, sf_dir):
    """Each line its own block, with byte ranges."""
    return B.split_long_paragraphs(parse(tables.document_texts(spark, sf_dir), guarded=True), (".",)).select("doc_id", "block_idx", "text", "start_byte", "end_byte")


@query(RUNS.format(hit="regexp_matches(text, '^The ') AND NOT contains(text, 'with')"))
def auto_split_paragraphs(spark, sf_dir):
    """Split at lines that read like headings."""
    return B.auto_split_paragraphs(parse(tables.document_texts(spark, sf_dir), guarded=True), PSEUDO).select("doc_id", "block_idx", "text", "start_byte", "end_byte")


@query("SELECT item_id, gram, count(*) AS tf FROM (SELECT item_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS gram FROM benchmark) GROUP BY ALL")
def char_trigrams(spark, sf_dir):
    """G6."""
    grams = tables.table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.char_trigrams(F.col("text"))).alias("gram"))
    return grams.groupBy("item_id", "gram").agg(F.count(F.lit(1)).alias("tf"))


@query(rf"WITH {CONV} SELECT doc_id, token, count(*) AS df FROM (SELECT DISTINCT doc_id, block_idx, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+')) AS token FROM blocks) GROUP BY ALL")
def token_set_df(spark, sf_dir):
    """G7, A2."""
    return S.token_df(conv_blocks(spark, sf_dir))


TFIDF = f"""
WITH {CONV},
grams AS (
    SELECT doc_id, block_idx, gram, count(*) AS tf FROM (SELECT doc_id, block_idx, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS gram FROM blocks) GROUP BY ALL),
dfs AS (SELECT doc_id, gram, count(*) AS df FROM grams GROUP BY ALL), ns AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY ALL),
weights AS (
    SELECT doc_id, block_idx, (961 * unicode(substr(gram, 1, 1)) + 31 * unicode(substr(gram, 2, 1)) + unicode(substr(gram, 3, 1))) % 256 AS bucket, sum(tf * ln(1 + n / (df + 1))) AS weight
    FROM grams JOIN dfs USING (doc_id, gram) JOIN ns USING (doc_id) GROUP BY ALL)"""


@query(f"{TFIDF} SELECT doc_id, block_idx, bucket::BIGINT AS bucket, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id, block_idx)), {DIGITS}) AS value FROM weights")
def tfidf_vectors(spark, sf_dir):
    """Non-zero entries of the vectors."""
    v = embed.tfidf(conv_blocks(spark, sf_dir))
    return v.select("doc_id", "block_idx", F.posexplode("vector").alias("bucket", "value")).where("value <> 0")


@query(f"WITH {CONV}, c AS (SELECT doc_id, block_idx, unicode(c) % 128 AS bucket, count(*) AS n FROM (SELECT doc_id, block_idx, unnest(string_split(text, '')) AS c FROM blocks) WHERE c <> '' GROUP BY ALL) SELECT doc_id, block_idx, bucket::BIGINT AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, block_idx)), {DIGITS}) AS value FROM c")
def charfreq_vectors(spark, sf_dir):
    """A9, E2."""
    v = embed.charfreq(conv_blocks(spark, sf_dir))
    return v.select("doc_id", "block_idx", F.posexplode("vector").alias("bucket", "value")).where("value <> 0")


@query(f"WITH {EMB} SELECT doc_id, gap_idx, round(similarity, {DIGITS}) AS similarity FROM sims")
def adjacent_cosine(spark, sf_dir):
    """W2, F25."""
    return G.similarities(tables.embedding_sequence(spark, sf_dir))


@query(f"""
WITH {EMB}, items AS (SELECT doc_id, block_idx, unnest(vector) AS x, unnest(range(len(vector))) AS i FROM seq),
ls AS (SELECT a.doc_id, a.block_idx AS g, b.i, avg(b.x) AS x FROM seq a JOIN items b ON a.doc_id = b.doc_id AND b.block_idx BETWEEN a.block_idx - 2 AND a.block_idx GROUP BY ALL),
rs AS (SELECT a.doc_id, a.block_idx AS g, b.i, avg(b.x) AS x FROM seq a JOIN items b ON a.doc_id = b.doc_id AND b.block_idx BETWEEN a.block_idx + 1 AND a.block_idx + 3 GROUP BY ALL)
SELECT doc_id, g AS gap_idx, round(sum(ls.x * rs.x) / sqrt(sum(ls.x * ls.x) * sum(rs.x * rs.x)), {DIGITS}) AS similarity FROM ls JOIN rs USING (doc_id, g, i) GROUP BY ALL""")
def window_cosine_k3(spark, sf_dir):
    """W3, A3."""
    return G.similarities(tables.embedding_sequence(spark, sf_dir), 3)


@query(f"WITH {EMB} SELECT doc_id, gap_idx, round(avg(similarity) OVER (PARTITION BY doc_id ORDER BY gap_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), {DIGITS}) AS similarity FROM sims")
def smooth_w2(spark, sf_dir):
    """W4."""
    return G.smooth(G.similarities(tables.embedding_sequence(spark, sf_dir)), 2)


@query(f"WITH {EMB} SELECT doc_id, gap_idx, round(depth, {DIGITS}) AS depth FROM depths")
def depth_score(spark, sf_dir):
    """W5."""
    return G.with_depth(G.similarities(tables.embedding_sequence(spark, sf_dir))).select("doc_id", "gap_idx", "depth")


@query(f"WITH {EMB} SELECT doc_id, gap_idx FROM scored WHERE depth > threshold AND depth > 0")
def depth_threshold_boundaries(spark, sf_dir):
    """The offline detector of depth over mean less half a deviation."""
    v = tables.embedding_sequence(spark, sf_dir)
    return D.DepthThreshold().detect(v, G.similarities(v))


@query(f"WITH {EMB} SELECT doc_id, gap_idx, round(confidence, {DIGITS}) AS confidence FROM sure")
def boundary_confidence(spark, sf_dir):
    """A6, F26."""
    return G.with_confidence(D.DepthThreshold().scored(G.similarities(tables.embedding_sequence(spark, sf_dir)))).select("doc_id", "gap_idx", "confidence")


@query(f"WITH {CONV} SELECT doc_id, block_idx - 1 AS gap_idx FROM blocks WHERE kind = 'heading' AND block_idx > 0")
def heading_split(spark, sf_dir):
    """D1, D3."""
    return D.HeadingSplit().detect(conv_blocks(spark, sf_dir))


LAST = "last AS (SELECT *, max(block_idx) OVER (PARTITION BY doc_id) AS top FROM blocks)"


@query(f"WITH {CONV}, {LAST} SELECT doc_id, block_idx AS gap_idx FROM last WHERE (block_idx + 1) % {FIXED} = 0 AND block_idx < top")
def fixed_split(spark, sf_dir):
    """D4."""
    return D.FixedSplit(FIXED).detect(conv_blocks(spark, sf_dir))


@query(f"WITH {CONV}, {LAST} SELECT doc_id, block_idx AS gap_idx FROM last WHERE block_idx < top QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5('42:' || doc_id || ':' || block_idx), block_idx) <= 4")
def random_split(spark, sf_dir):
    """D5."""
    return D.RandomSplit(4).detect(conv_blocks(spark, sf_dir))


@query(f"WITH {CONV} SELECT doc_id, greatest(2, (max(block_idx) + 1) // (max(turn) + 2))::BIGINT AS size FROM blocks GROUP BY doc_id")
def average_fixed_size(spark, sf_dir):
    """D6 with one gold boundary a turn."""
    b = conv_blocks(spark, sf_dir)
    return D.average_fixed_size(b, b.where("kind = 'heading' and heading_level = 2"))


@query(f"WITH {CONV}, n AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY ALL), c AS (SELECT doc_id, block_idx * 2 - 3 AS gap_idx FROM blocks UNION ALL SELECT doc_id, 1 FROM blocks) SELECT DISTINCT doc_id, gap_idx FROM c JOIN n USING (doc_id) WHERE gap_idx BETWEEN 0 AND n - 2")
def validate_boundaries(spark, sf_dir):
    """Out-of-range and repeated boundaries leave."""
    b = conv_blocks(spark, sf_dir).select("doc_id", "block_idx")
    wild = b.select("doc_id", (F.col("block_idx") * 2 - 3).alias("gap_idx")).unionByName(b.select("doc_id", F.lit(1).alias("gap_idx")))
    return D.validate(wild, b)


@query(f"""
WITH {CONV}, {LAST}, p AS (SELECT *, max(CASE WHEN kind <> 'heading' THEN block_idx END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS plain FROM last)
SELECT DISTINCT doc_id, CASE WHEN kind = 'heading' AND block_idx > 0 THEN greatest(coalesce(plain, -1), 0) ELSE block_idx END AS gap_idx FROM p WHERE (block_idx + 1) % 2 = 0 AND block_idx < top""")
def adjust_heading_boundaries(spark, sf_dir):
    """W8."""
    b = conv_blocks(spark, sf_dir)
    return S.adjust_heading_boundaries(b, D.FixedSplit(2).detect(b))


@query(rf"""
WITH {FLAT}, last AS (SELECT *, max(block_idx) OVER (PARTITION BY doc_id) AS top FROM flat),
toks AS (SELECT DISTINCT doc_id, block_idx, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+')) AS token FROM flat),
dfs AS (SELECT doc_id, token, 1.0 / count(*) AS idf FROM toks GROUP BY ALL),
cuts AS (SELECT doc_id, block_idx AS b FROM last WHERE (block_idx + 1) % {FIXED} = 0 AND block_idx < top),
near AS (
    SELECT DISTINCT c.doc_id, b, token, CASE WHEN t.block_idx = b THEN 0 WHEN t.block_idx < b THEN 1 ELSE 2 END AS side
    FROM cuts c JOIN toks t ON t.doc_id = c.doc_id AND t.block_idx BETWEEN b - 3 AND b + 3),
flags AS (SELECT doc_id, b, token, bool_or(side = 0) AS own, bool_or(side = 1) AS pre, bool_or(side = 2) AS post FROM near GROUP BY ALL),
fits AS (
    SELECT doc_id, b, coalesce(coalesce(sum(idf) FILTER (own AND pre), 0) / sum(idf) FILTER (own OR pre), 1) AS pre, coalesce(coalesce(sum(idf) FILTER (own AND post), 0) / sum(idf) FILTER (own OR post), 1) AS post
    FROM flags JOIN dfs USING (doc_id, token) GROUP BY ALL)
SELECT DISTINCT doc_id, CASE WHEN post > pre + 1e-12 THEN b - 1 ELSE b END AS gap_idx FROM cuts LEFT JOIN fits USING (doc_id, b)""")
def adjust_flat_boundaries(spark, sf_dir):
    """W9, W10."""
    b = parse(tables.flat_documents(spark, sf_dir), guarded=True)
    return S.adjust_flat_boundaries(b, D.FixedSplit(FIXED).detect(b))


@query(f"WITH {CONV}, {FIXED_SEGS} SELECT doc_id, seg_idx, min(block_idx) AS first_block, max(block_idx) AS last_block, min_by(path, block_idx) AS path, min(start_byte) AS start_byte, max(end_byte) AS end_byte, sum(tokens)::BIGINT AS token_count, sum(lines)::BIGINT AS line_count, count(*) AS block_count FROM fixed GROUP BY ALL")
def split_at_boundaries(spark, sf_dir):
    """W11, A1, I5."""
    b = conv_blocks(spark, sf_dir)
    s = S.roll_up(S.split_at(b, D.FixedSplit(FIXED).detect(b)))
    return s.select("doc_id", "seg_idx", "first_block", "last_block", joined(), "start_byte", "end_byte", "token_count", "line_count", "block_count")


def _sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("doc_id", "seg_idx").agg(F.min("block_idx").alias("first_block"), F.sum("tokens").alias("token_count"))


# From small (doc_id, a: first block, t: tokens), the scan that starts over after each merge; lists hold what is left.
MERGE = """small AS ({small}),
scan AS (
    SELECT doc_id, list(t ORDER BY a) AS ts, list(a ORDER BY a) AS firsts FROM small GROUP BY doc_id
    UNION ALL
    SELECT doc_id, list_slice(ts, 1, j - 1) || [ts[j] + ts[j + 1]] || list_slice(ts, j + 2, len(ts)), list_slice(firsts, 1, j) || list_slice(firsts, j + 2, len(firsts))
    FROM (SELECT *, CASE WHEN i = 1 THEN 1 WHEN i = len(ts) OR ts[i - 1] <= ts[i + 1] THEN i - 1 ELSE i END AS j
          FROM (SELECT *, list_position([x < {least} FOR x IN ts], true) AS i FROM scan) WHERE i > 0 AND len(ts) > 1)),
merged AS (SELECT doc_id, unnest(f.firsts) AS a, unnest(f.ts) AS t FROM (SELECT doc_id, arg_min({{'ts': ts, 'firsts': firsts}}, len(ts)) AS f FROM scan GROUP BY doc_id))"""


@query(f"WITH RECURSIVE {CONV}, {MERGE.format(small='SELECT doc_id, first_block AS a, token_count AS t FROM segs', least=MIN_TOKENS)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS seg_idx, a AS first_block, t::BIGINT AS token_count FROM merged")
def merge_undersized(spark, sf_dir):
    """Q1: an order-dependent fold."""
    return _sizes(S.merge_undersized(by_headings(conv_blocks(spark, sf_dir)), MIN_TOKENS))


# From whole (doc_id, a: first block, z: last block) and blocks, cuts in the middle until nothing is over the limit.
CUT = """whole AS ({whole}),
cut AS (
    SELECT doc_id, a, z, 0 AS depth FROM whole
    UNION ALL
    SELECT c.doc_id, h.a, h.z, c.depth + 1 FROM cut c, LATERAL (SELECT sum(tokens) AS t FROM blocks b WHERE b.doc_id = c.doc_id AND b.block_idx BETWEEN c.a AND c.z) s,
        LATERAL (SELECT c.a AS a, c.a + greatest((c.z - c.a + 1) // 2 - 1, 0) AS z UNION ALL SELECT c.a + greatest((c.z - c.a + 1) // 2 - 1, 0) + 1, c.z) h
    WHERE c.z > c.a AND s.t > {limit} AND c.depth < 20),
done AS (
    SELECT c.doc_id, c.a, c.z, s.t FROM cut c, LATERAL (SELECT sum(tokens) AS t FROM blocks b WHERE b.doc_id = c.doc_id AND b.block_idx BETWEEN c.a AND c.z) s
    WHERE c.z = c.a OR s.t <= {limit} OR c.depth >= 20)"""


@query(f"WITH RECURSIVE {CONV}, {CUT.format(whole='SELECT doc_id, first_block AS a, last_block AS z FROM segs', limit=MAX_TOKENS)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS seg_idx, a AS first_block, t::BIGINT AS token_count FROM done")
def split_oversized(spark, sf_dir):
    """Q2 without depths: cuts in the middle."""
    return _sizes(S.split_oversized(by_headings(conv_blocks(spark, sf_dir)), None, MAX_TOKENS, 0))


PACK = """
WITH RECURSIVE {prelude},
given AS ({given}),
fold AS (
    SELECT doc_id, seg_idx, 0 AS k, t, first_block FROM given WHERE seg_idx = 0
    UNION ALL
    SELECT g.doc_id, g.seg_idx, CASE WHEN f.t + g.t <= {limit} AND NOT g.stop THEN f.k ELSE f.k + 1 END, CASE WHEN f.t + g.t <= {limit} AND NOT g.stop THEN f.t + g.t ELSE g.t END, g.first_block
    FROM fold f JOIN given g ON g.doc_id = f.doc_id AND g.seg_idx = f.seg_idx + 1)
SELECT doc_id, k::BIGINT AS seg_idx, min(first_block) AS first_block, max(t)::BIGINT AS token_count FROM fold GROUP BY doc_id, k"""


@query(PACK.format(prelude=CONV, limit=400, given="SELECT doc_id, seg_idx, token_count AS t, first_block, false AS stop FROM segs"))
def pack_segments(spark, sf_dir):
    """Q3."""
    return _sizes(S.pack_segments(by_headings(conv_blocks(spark, sf_dir)), 400, 0))


@query(PACK.format(prelude=f"{CONV}, {FIXED_SEGS}", limit=400, given="SELECT doc_id, seg_idx, sum(tokens) AS t, min(block_idx) AS first_block, min_by(kind, block_idx) = 'heading' AS stop FROM fixed GROUP BY doc_id, seg_idx"))
def pack_barrier(spark, sf_dir):
    """Q3 with headings of level 2 and above as barriers."""
    b = conv_blocks(spark, sf_dir)
    return _sizes(S.pack_segments(S.split_at(b, D.FixedSplit(FIXED).detect(b)), 400, 0, barrier=2))


SNAPPED = f"""{LAST}, plain AS (SELECT *, max(CASE WHEN kind <> 'heading' THEN block_idx END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS plain FROM last),
snapped AS (SELECT DISTINCT doc_id, CASE WHEN kind = 'heading' AND block_idx > 0 THEN greatest(coalesce(plain, -1), 0) ELSE block_idx END AS gap_idx FROM plain WHERE (block_idx + 1) % 2 = 0 AND block_idx < top),
numbered AS (SELECT b.doc_id, b.block_idx, b.tokens, (SELECT count(*) FROM snapped s WHERE s.doc_id = b.doc_id AND s.gap_idx < b.block_idx) AS seg FROM blocks b)"""
OPTIMIZED = ", ".join([
    CONV, SNAPPED,
    MERGE.format(small="SELECT doc_id, min(block_idx) AS a, sum(tokens)::BIGINT AS t FROM numbered GROUP BY doc_id, seg", least=40),
    CUT.format(whole="SELECT doc_id, a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a) - 1, (SELECT max(block_idx) FROM blocks b WHERE b.doc_id = merged.doc_id)) AS z FROM merged", limit=400),
])


@query(PACK.format(prelude=OPTIMIZED, limit=400, given="SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS seg_idx, t, a AS first_block, kind = 'heading' AND heading_level <= 1 AS stop FROM done JOIN (SELECT doc_id, block_idx AS a, kind, heading_level FROM blocks) USING (doc_id, a)"))
def optimize_all(spark, sf_dir):
    """Q4: all steps with limits."""
    b = conv_blocks(spark, sf_dir)
    return _sizes(S.optimize(b, D.FixedSplit(2).detect(b), S.OptimizeConfig(40, 400, 0, 1)))


@query(f"WITH {CONV} SELECT doc_id, seg_idx, segment_id, lag(segment_id) OVER w AS prev_segment_id, lead(segment_id) OVER w AS next_segment_id FROM ids WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx)")
def segment_ids_links(spark, sf_dir):
    """F23, W6, I8."""
    return conv_segments(spark, sf_dir)[2].select("doc_id", "seg_idx", "segment_id", "prev_segment_id", "next_segment_id")


def emb_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.embedding_sequence(spark, sf_dir)
    return S.split_at(v, D.FixedSplit(5).detect(v))


COHERENCE = "coh AS (SELECT doc_id, block_idx // 5 AS seg_idx, coalesce((SELECT avg(list_cosine_similarity(a.vector, b.vector)) FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND a.block_idx // 5 = b.block_idx // 5 AND a.block_idx < b.block_idx WHERE a.doc_id = s.doc_id AND a.block_idx // 5 = s.block_idx // 5), 1.0) AS coherence FROM seq s WHERE block_idx % 5 = 0)"


@query(f"WITH {EMB}, {COHERENCE} SELECT doc_id, seg_idx, round(coherence, {DIGITS}) AS coherence FROM coh")
def coherence(spark, sf_dir):
    """A5 against the pairwise mean."""
    return Q.coherence(emb_assigned(spark, sf_dir), tables.embedding_sequence(spark, sf_dir))


@query(f"""
WITH {EMB}, {COHERENCE}, c AS (SELECT doc_id, avg(coherence) AS avg_coherence, min(coherence) AS min_coherence, greatest(0, least(1, 1 - abs(count(*) - 10) / 10)) AS size_score FROM coh GROUP BY ALL),
b AS (SELECT doc_id, avg(confidence) AS avg_confidence FROM sure WHERE (gap_idx + 1) % 5 = 0 GROUP BY ALL)
SELECT doc_id, round(avg_coherence, {DIGITS}) AS avg_coherence, round(min_coherence, {DIGITS}) AS min_coherence, round(coalesce(avg_confidence, 0), {DIGITS}) AS avg_confidence, round(size_score, {DIGITS}) AS size_score FROM c LEFT JOIN b USING (doc_id)""")
def quality_metrics(spark, sf_dir):
    """A7."""
    v = tables.embedding_sequence(spark, sf_dir)
    sure = G.with_confidence(D.DepthThreshold().scored(G.similarities(v))).join(D.FixedSplit(5).detect(v), ["doc_id", "gap_idx"])
    return Q.document_metrics(Q.coherence(emb_assigned(spark, sf_dir), v), sure)


@query(f"WITH {EMB}, items AS (SELECT doc_id, block_idx // 5 AS seg_idx, unnest(vector) AS x, unnest(range(len(vector))) AS i FROM seq) SELECT doc_id, seg_idx, i, round(avg(x), {DIGITS}) AS value FROM items GROUP BY ALL")
def segment_embedding_avg(spark, sf_dir):
    """A3, A4, J3."""
    m = Q.mean_vectors(emb_assigned(spark, sf_dir), tables.embedding_sequence(spark, sf_dir).select("doc_id", "block_idx", "vector"))
    return m.select("doc_id", "seg_idx", F.posexplode("vector").alias("i", "value"))


OVER = f"over_blocks AS (SELECT b.doc_id, s.seg_idx, b.block_idx, b.raw, 2 * (s.last_block - b.block_idx) AS after, max(s.seg_idx) OVER (PARTITION BY b.doc_id) AS top FROM blocks b JOIN segs s ON b.doc_id = s.doc_id AND b.block_idx BETWEEN s.first_block AND s.last_block)"


@query(f"WITH {CONV}, {OVER} SELECT doc_id, seg_idx + 1 AS seg_idx, block_idx FROM over_blocks WHERE after < {OVERLAP} AND seg_idx < top")
def overlap_blocks(spark, sf_dir):
    """W12."""
    return S.overlap_blocks(by_headings(conv_blocks(spark, sf_dir)), OVERLAP).select("doc_id", "seg_idx", "block_idx")


@query(f"""
WITH {CONV}, {OVER}, shown AS (SELECT doc_id, seg_idx + 1 AS seg_idx, string_agg(raw, '' ORDER BY block_idx) AS shown FROM over_blocks WHERE after < {OVERLAP} AND seg_idx < top GROUP BY ALL)
SELECT doc_id, seg_idx, sha256(CASE WHEN path = '' THEN '' ELSE '<!-- context: ' || path || ' -->' || chr(10) || chr(10) END || coalesce(shown, '') || raw) AS rendered_sha256 FROM ids LEFT JOIN shown USING (doc_id, seg_idx)""")
def render_segments(spark, sf_dir):
    """K1 with context and overlap."""
    sources, assigned, segments = conv_segments(spark, sf_dir)
    return R.render(segments, assigned, sources, overlap=OVERLAP).select("doc_id", "seg_idx", F.sha2("rendered", 256).alias("rendered_sha256"))


@query(f"WITH {CONV} SELECT doc_id, seg_idx, sha256(raw) AS stripped_sha256 FROM segs")
def strip_context(spark, sf_dir):
    """what rendering adds comes off again, as comment and as front matter."""
    sources, assigned, segments = conv_segments(spark, sf_dir)
    even = F.col("seg_idx") % 2 == 0
    both = R.render(segments.where(even), assigned, sources, "comment").unionByName(R.render(segments.where(~even), assigned, sources, "front-matter"))
    return both.select("doc_id", "seg_idx", F.sha2(T.strip_context(F.col("rendered")), 256).alias("stripped_sha256"))


@query(f"WITH {CONV} SELECT doc_id, sha256(string_agg(rendered, '' ORDER BY seg_idx)) AS merged_sha256 FROM ids GROUP BY doc_id")
def merge_segments(spark, sf_dir):
    """K5."""
    sources, assigned, segments = conv_segments(spark, sf_dir)
    return R.with_glue(R.render(segments, assigned, sources)).select("doc_id", F.sha2("merged", 256).alias("merged_sha256"))


@query(f"WITH {CONV} SELECT doc_id, sha256(string_agg(raw, '' ORDER BY block_idx)) AS merged_sha256 FROM blocks GROUP BY doc_id")
def lossless_roundtrip(spark, sf_dir):
    """Split, render, strip, merge gives the source."""
    sources, assigned, segments = conv_segments(spark, sf_dir)
    return R.with_glue(R.render(segments, assigned, sources), strip=True).select("doc_id", F.sha2("merged", 256).alias("merged_sha256"))


LABEL = "CASE WHEN seg_idx = 0 THEN title ELSE path || ' > ' || title END"


@query(f"WITH {CONV} SELECT doc_id, seg_idx, {LABEL} AS label, replace(lower(title), ' ', '-') AS anchors FROM ids")
def dag_nodes(spark, sf_dir):
    """F15-F17, K6."""
    _, assigned, segments = conv_segments(spark, sf_dir, linked=True)
    return L.nodes(segments, assigned).select("doc_id", "seg_idx", "label", F.array_join("anchors", ",").alias("anchors"))


EDGES = """edges AS (
    SELECT doc_id, seg_idx AS from_seg, 0 AS to_seg, 0 AS nth FROM segs WHERE seg_idx > 0
    UNION ALL SELECT a.doc_id, a.seg_idx, b.seg_idx, 1 FROM segs a JOIN segs b ON a.doc_id = b.doc_id AND b.title = (a.turn + 1) || ' user' WHERE a.seg_idx > 0)"""


@query(f"WITH {CONV}, {EDGES} SELECT doc_id, from_seg, to_seg, 'link' AS type FROM edges")
def dag_edges(spark, sf_dir):
    """F18, J5."""
    _, assigned, segments = conv_segments(spark, sf_dir, linked=True)
    return L.edges(segments, L.nodes(segments, assigned)).drop("nth")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _, assigned, segments = conv_segments(spark, sf_dir, linked=True)
    nodes = L.nodes(segments, assigned).join(segments.select("doc_id", "seg_idx", "filename"), ["doc_id", "seg_idx"])
    return nodes, L.edges(segments, nodes)


@query(f"""
WITH {CONV}, {EDGES}, named AS (SELECT *, {LABEL} AS label FROM ids),
t AS (SELECT doc_id, string_agg('| ' || (seg_idx + 1) || ' | [' || filename || '](' || filename || ') | ' || label || ' |' || chr(10), '' ORDER BY seg_idx) AS t,
             string_agg('  ' || seg_idx || '["' || (seg_idx + 1) || '. ' || title || '"]' || chr(10), '' ORDER BY seg_idx) AS b,
             coalesce(string_agg('  ' || (seg_idx - 1) || ' --> ' || seg_idx || chr(10), '' ORDER BY seg_idx) FILTER (seg_idx > 0), '') AS s FROM named GROUP BY ALL),
r AS (SELECT doc_id, string_agg('  ' || from_seg || ' -.->|link| ' || to_seg || chr(10), '' ORDER BY from_seg, nth) AS r FROM edges GROUP BY ALL)
SELECT doc_id, '# Index' || chr(10) || chr(10) || '| # | File | Section |' || chr(10) || '|---|------|--------|' || chr(10) || t || chr(10) || '## Graph' || chr(10) || chr(10) || '```mermaid' || chr(10) || 'graph LR' || chr(10) || b || s || coalesce(r, '') || '```' || chr(10) AS index_md
FROM t LEFT JOIN r USING (doc_id)""")
def index_markdown(spark, sf_dir):
    """F19, K7."""
    return L.index_markdown(*_graph(spark, sf_dir))


@query(f"""
WITH {CONV}, {EDGES}, n AS (SELECT doc_id, string_agg('  ' || seg_idx || ' [label="' || {LABEL} || '"];' || chr(10), '' ORDER BY seg_idx) AS n FROM ids GROUP BY ALL),
r AS (SELECT doc_id, string_agg('  ' || from_seg || ' -> ' || to_seg || ' [label="link"];' || chr(10), '' ORDER BY from_seg, nth) AS r FROM edges GROUP BY ALL)
SELECT doc_id, 'digraph segments {{' || chr(10) || '  rankdir=LR;' || chr(10) || n || coalesce(r, '') || '}}' || chr(10) AS dot FROM n LEFT JOIN r USING (doc_id)""")
def dag_dot(spark, sf_dir):
    """K8."""
    return L.dot(*_graph(spark, sf_dir))


@query(f"""
WITH {CONV}, {EDGES}, n AS (SELECT doc_id, string_agg('{{"id":' || seg_idx || ',"label":"' || {LABEL} || '","anchors":["' || replace(lower(title), ' ', '-') || '"]}}', ',' ORDER BY seg_idx) AS n FROM ids GROUP BY ALL),
r AS (SELECT doc_id, string_agg('{{"from":' || from_seg || ',"to":' || to_seg || ',"type":"link"}}', ',' ORDER BY from_seg, nth) AS r FROM edges GROUP BY ALL)
SELECT doc_id, '{{"nodes":[' || n || '],"edges":[' || coalesce(r, '') || ']}}' AS graph FROM n LEFT JOIN r USING (doc_id)""")
def dag_json(spark, sf_dir):
    """K8."""
    return L.graph_json(*_graph(spark, sf_dir))


@query(f"WITH {CONV} SELECT doc_id, seg_idx, sha256(rendered) AS content_sha256, source_name AS source, filename, '[' || start_byte || ',' || end_byte || ']' AS byte_range, token_count, segment_id, lag(segment_id) OVER (PARTITION BY doc_id ORDER BY seg_idx) AS prev_segment_id, NULL::VARCHAR AS coherence FROM ids")
def jsonl_records(spark, sf_dir):
    """K4: fields read back from the JSON lines; what is null is left out."""
    sources, assigned, segments = conv_segments(spark, sf_dir)
    lines = R.jsonl(R.render(segments, assigned, sources))
    get = lambda path: F.get_json_object("line", f"$.{path}")
    m = {c: get(f"metadata.{c}").alias(c) for c in ("source", "filename", "byte_range", "segment_id", "prev_segment_id", "coherence")}
    return lines.select("doc_id", "seg_idx", F.sha2(get("content"), 256).alias("content_sha256"), get("metadata.token_count").cast("long").alias("token_count"), *m.values())


@query(f"WITH {CONV} SELECT doc_id, count(*) AS segments, sum(token_count)::BIGINT AS total_tokens, '[' || coalesce(string_agg(last_block::VARCHAR, ',' ORDER BY seg_idx) FILTER (seg_idx < top), '') || ']' AS boundaries FROM (SELECT *, max(seg_idx) OVER (PARTITION BY doc_id) AS top FROM segs) GROUP BY doc_id")
def summary(spark, sf_dir):
    """A15, K9, F34."""
    assigned = by_headings(conv_blocks(spark, sf_dir))
    return R.summary(S.roll_up(assigned), E.final_boundaries(assigned))


@query(f"WITH {CONV} SELECT doc_id, block_idx, text IN (SELECT text FROM blocks WHERE doc_id % 2 = 0) AS cached, 128::BIGINT AS dims FROM blocks")
def cache_probe(spark, sf_dir):
    """Vectors from the cache or the provider, and which."""
    config = ProviderConfig("mock")
    blocks = conv_blocks(spark, sf_dir)
    half = blocks.where("doc_id % 2 = 0")
    cache = keyed(half, config).join(create(config)(half), ["doc_id", "block_idx"]).groupBy("key").agg(F.min("vector").alias("vector"))
    vectors, _ = with_cache(blocks, cache, config)
    hits = keyed(blocks, config).join(cache.select("key", F.lit(True).alias("hit")), "key", "left").select("doc_id", "block_idx", F.coalesce("hit", F.lit(False)).alias("cached"))
    return vectors.select("doc_id", "block_idx", F.size("vector").alias("dims")).join(hits, ["doc_id", "block_idx"])


@query(f"""
WITH {CONV}, named AS (SELECT doc_id, seg_idx, source_name, CASE WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 2 = 0 OR seg_idx = 0 THEN 'unchanged' ELSE 'changed' END AS c FROM ids)
SELECT source_name, change, count(*) AS n FROM (SELECT source_name, unnest(CASE WHEN c = 'changed' THEN ['added', 'removed'] ELSE [c] END) AS change FROM named) GROUP BY ALL""")
def incremental_diff(spark, sf_dir):
    """Some sources changed, some gone."""
    def state(linked: bool) -> DataFrame:
        sources, _, segments = conv_segments(spark, sf_dir, linked)
        return I.build_state(segments, sources).withColumn("id", F.regexp_extract("source_name", r"(\d+)", 1).cast("long"))

    old, new = state(False), state(True)
    now = old.where("id % 2 = 0 and id % 7 <> 0").unionByName(new.where("id % 2 = 1 and id % 7 <> 0"))
    return I.diff(old, now).groupBy("source_name", "change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CONV} SELECT DISTINCT doc_id FROM segs WHERE doc_id % 2 = 1")
def changed_sources(spark, sf_dir):
    """The anti-join that lets unchanged sources leave early."""
    sources, _, segments = conv_segments(spark, sf_dir)
    new = sources.where("doc_id % 2 = 0").unionByName(tables.linked_conversations(spark, sf_dir).where("doc_id % 2 = 1"))
    return I.changed_sources(new, I.build_state(segments, sources)).select("doc_id")


def gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sizes, gold boundaries (after label 0) and fixed boundaries of the embedding sequences."""
    v = tables.embedding_sequence(spark, sf_dir)
    sizes = v.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    ref = v.join(sizes, "doc_id").where("label = 0 and block_idx < n - 1").select("doc_id", F.col("block_idx").alias("gap_idx"))
    return sizes, ref, D.FixedSplit(5).detect(v)


GOLD = f"""{EMB}, sizes AS (SELECT doc_id, count(*) AS n FROM seq GROUP BY ALL),
ref AS (SELECT doc_id, block_idx AS gap_idx FROM seq JOIN sizes USING (doc_id) WHERE label = 0 AND block_idx < n - 1),
hyp AS (SELECT doc_id, block_idx AS gap_idx FROM seq JOIN sizes USING (doc_id) WHERE (block_idx + 1) % 5 = 0 AND block_idx < n - 1),
ks AS (SELECT doc_id, n, greatest(1, least(greatest(1, floor(n / ((SELECT count(*) FROM ref WHERE ref.doc_id = sizes.doc_id) + 1) / 2)), n - 1))::BIGINT AS k FROM sizes),
maps AS (SELECT doc_id, block_idx AS i, (SELECT count(*) FROM ref WHERE ref.doc_id = seq.doc_id AND gap_idx < block_idx) AS r, (SELECT count(*) FROM hyp WHERE hyp.doc_id = seq.doc_id AND gap_idx < block_idx) AS h FROM seq),
wins AS (SELECT a.doc_id, ((a.r = b.r) <> (a.h = b.h))::INT AS pk, (b.r - a.r <> b.h - a.h)::INT AS wd FROM maps a JOIN ks USING (doc_id) JOIN maps b ON b.doc_id = a.doc_id AND b.i = a.i + k),
win AS (SELECT doc_id, avg(pk) AS pk, avg(wd) AS window_diff FROM wins GROUP BY ALL),
tp AS (SELECT doc_id, (SELECT count(*) FROM ref JOIN hyp USING (doc_id, gap_idx) WHERE ref.doc_id = sizes.doc_id) AS tp, (SELECT count(*) FROM ref WHERE ref.doc_id = sizes.doc_id) AS nr, (SELECT count(*) FROM hyp WHERE hyp.doc_id = sizes.doc_id) AS nh FROM sizes),
prf AS (SELECT doc_id, nh, CASE WHEN nr = 0 AND nh = 0 THEN 1 WHEN nh = 0 THEN 0 ELSE tp / nh END AS p, CASE WHEN nr = 0 AND nh = 0 THEN 1 WHEN nr = 0 THEN 0 ELSE tp / nr END AS q FROM tp)"""


@query(f"WITH {GOLD} SELECT doc_id, i, r FROM maps")
def segment_map(spark, sf_dir):
    """W13, W14."""
    sizes, ref, _ = gold(spark, sf_dir)
    return E.segment_map(sizes, ref, "r")


@query(f"WITH {GOLD} SELECT doc_id, round(pk, {DIGITS}) AS pk FROM win")
def pk(spark, sf_dir):
    """A10, A12."""
    return E.window_metrics(*gold(spark, sf_dir)).select("doc_id", "pk")


@query(f"WITH {GOLD} SELECT doc_id, round(window_diff, {DIGITS}) AS window_diff FROM win")
def window_diff(spark, sf_dir):
    """A11."""
    return E.window_metrics(*gold(spark, sf_dir)).select("doc_id", "window_diff")


@query(f"WITH {GOLD} SELECT doc_id, round(p, {DIGITS}) AS precision, round(q, {DIGITS}) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, {DIGITS}) AS f1 FROM prf")
def boundary_prf_tol0(spark, sf_dir):
    """A13."""
    return E.boundary_prf(*gold(spark, sf_dir), tolerance=0)


@query(f"""
WITH RECURSIVE {GOLD},
found AS (SELECT doc_id, gap_idx AS x, row_number() OVER (PARTITION BY doc_id ORDER BY gap_idx) AS i FROM hyp),
golds AS (SELECT doc_id, list(gap_idx) AS free FROM ref GROUP BY doc_id),
greedy AS (
    SELECT doc_id, 0::BIGINT AS i, coalesce(free, []) AS free, 0::BIGINT AS tp FROM sizes LEFT JOIN golds USING (doc_id)
    UNION ALL
    SELECT doc_id, i, [g FOR g IN free IF hit IS NULL OR g <> hit], tp + (hit IS NOT NULL)::BIGINT
    FROM (SELECT g.doc_id, f.i, g.free, g.tp, CASE WHEN list_contains(free, x) THEN x WHEN list_contains(free, x - 1) THEN x - 1 WHEN list_contains(free, x + 1) THEN x + 1 END AS hit
          FROM greedy g JOIN found f ON f.doc_id = g.doc_id AND f.i = g.i + 1)),
near AS (SELECT doc_id, max(greedy.tp) AS hits FROM greedy GROUP BY doc_id),
rates AS (SELECT doc_id, CASE WHEN nr = 0 AND nh = 0 THEN 1 WHEN nh = 0 THEN 0 ELSE hits / nh END AS p, CASE WHEN nr = 0 AND nh = 0 THEN 1 WHEN nr = 0 THEN 0 ELSE hits / nr END AS q FROM tp JOIN near USING (doc_id))
SELECT doc_id, round(p, {DIGITS}) AS precision, round(q, {DIGITS}) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, {DIGITS}) AS f1 FROM rates""")
def boundary_prf_tol1(spark, sf_dir):
    """Greedy matching within one gap."""
    return E.boundary_prf(*gold(spark, sf_dir), tolerance=1)


@query(f"WITH {GOLD} SELECT doc_id, 'fixed-5' AS method, nh + 1 AS num_segments, round(pk, {DIGITS}) AS pk, round(window_diff, {DIGITS}) AS window_diff, round(p, {DIGITS}) AS precision, round(q, {DIGITS}) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, {DIGITS}) AS f1 FROM win JOIN prf USING (doc_id)")
def eval_report(spark, sf_dir):
    """A14, F33."""
    return E.evaluate(*gold(spark, sf_dir), "fixed-5", tolerance=0)


@query(f"WITH {CONV} SELECT doc_id, last_block AS gap_idx FROM (SELECT *, max(seg_idx) OVER (PARTITION BY doc_id) AS top FROM segs) WHERE seg_idx < top")
def final_boundaries(spark, sf_dir):
    """Boundaries read back from segments, checked."""
    b = conv_blocks(spark, sf_dir)
    return E.strict(E.final_boundaries(by_headings(b)), b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))


@query(f"""
WITH {CONV}
SELECT doc_id, '{INSTRUCTIONS[True, False]}' AS instruction, sha256('The document has ' || count(*) || ' blocks; gap indices 0 to ' || (count(*) - 2) || '.' || chr(10) || chr(10) ||
    string_agg('[Block ' || block_idx || '] (' || kind || CASE WHEN kind = 'heading' THEN ', level ' || heading_level ELSE '' END || ')' || chr(10) || text || chr(10) || chr(10), '' ORDER BY block_idx)) AS prompt_sha256
FROM blocks GROUP BY doc_id""")
def llm_prompt(spark, sf_dir):
    """F31, F32, A16."""
    return prompts(conv_blocks(spark, sf_dir)).select("doc_id", "instruction", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("SELECT doc_id, least(2000, greatest(200, n_chars // 10))::BIGINT AS max_lines FROM documents")
def auto_max_lines(spark, sf_dir):
    """F27."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", T.auto_max_lines(F.col("n_chars")).alias("max_lines"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS parts FROM documents")
def split_list(spark, sf_dir):
    """F30."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.split_list(F.col("text")), "|").alias("parts"))


@query(r"""
SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<a\s+(?:name|id)\s*=\s*"([^"]+)"', 1))) AS anchors, len(regexp_extract_all(html, '\[([^\]]*)\]\(#([^)]+)\)', 2)) AS links
FROM pages""")
def page_anchors(spark, sf_dir):
    """F17, F18 over raw pages."""
    return tables.table(spark, sf_dir, "pages").select("page_id", F.size(F.array_distinct(T.html_anchors(F.col("html")))).alias("anchors"), F.size(T.internal_links(F.col("html"))).alias("links"))


@query()
def depth_pipeline(spark, sf_dir):
    """The whole pipeline with vectors and the depth detector: segments with ids, coherence and confidence."""
    from .plans.pipeline import Config, run

    segments = run(tables.conversations(spark, sf_dir), Config(detector=D.DepthThreshold(), embedder=embed.tfidf)).segments
    return segments.select("doc_id", "seg_idx", "segment_id", "filename", "token_count", "coherence", "boundary_confidence")
