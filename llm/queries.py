"""The registered questions of this subpackage, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import (
    exact_dedup,
    fill_middle,
    jaccard_join,
    licenses,
    line_dedup,
    mixing,
    packing,
    pii,
    pivot_index,
    prefix_trie,
    substring_dedup,
    topk,
    toxicity,
)
from llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WHITE = "(chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def question(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return register


def tokenizer_files() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@question(f"""
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {LETTERS}) AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM t JOIN g USING (t)""")
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@question("""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
               FROM embeddings),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1),
                 lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
    WHERE rank <= 10""")
def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = topk.quantised(table(spark, folder, "embeddings"), "vec_id", "embedding", 1024)
    best = topk.top_k(rows.filter("key % 100 = 0"), rows, 10)
    return best.withColumnRenamed("key", "vec_id")


@question()
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), *tokenizer_files())


@question()
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents").select("doc_id", "source"), mixing.DEFAULT_WEIGHTS)


@question(f"""
    WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line
               FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
    k AS (SELECT *, translate(trim(line, {WHITE}), {LETTERS}) AS key FROM l),
    r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
          GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    m AS (SELECT k.*, r.first IS NOT NULL AND r.first <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
    SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
    FROM m GROUP BY doc_id""")
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, folder, "documents"), digest=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


@question()
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.DECISION).cast("int").alias("predicted"))


@question()
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    count = [F.size(pii.of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *count, F.sha2(pii.span_texts(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.span_texts(F.col("all")).alias("spans"))


@question()
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.license_notices(table(spark, folder, "documents"))
    return found.withColumn("exact", (F.size("missing") + F.size("added") == 0)).withColumn(
        "missing", F.array_join("missing", " ")).withColumn("added", F.array_join("added", " "))


@question("""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                 list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
    p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
    h AS (SELECT p.r, p.i, md5(array_to_string(list_slice(d.w, p.i, p.i + 34), ' ')) AS h FROM p JOIN d USING (r)),
    c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
    x AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM c),
    g AS (SELECT r, list(i) AS gone FROM x GROUP BY r)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
           sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1),
             lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN g USING (r)""")
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeated(table(spark, folder, "documents"), digest=True)
    return kept.withColumnRenamed("kept", "kept_sha256")


@question(f"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {LETTERS}),
        '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY ALL),
    l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
    r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
    m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id""")
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, folder, "documents"), 3, 90, 100)


@question("""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
    u AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
          CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
          CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
               WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
    FROM p""")
def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.rearrange(table(spark, folder, "documents"))
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(whole.cast("binary"), 256).alias("restored_sha256"))


@question("""
    WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
               FROM conversations WHERE conv_id IS NOT NULL),
    h AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
              string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
              lambda s, b: xor(xor(s, b) >> 1, 3988292384::BIGINT * (xor(s, b) & 1))), 4294967295::BIGINT) % 4 AS h
          FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT h.conv_id, 1 AS o, t.i, t.x FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.i <= h.h
          UNION ALL SELECT h.conv_id, 2, t.i, t.x FROM h JOIN t ON t.conv_id = h.conv_id AND t.i > h.h),
    s AS (SELECT h.conv_id, coalesce(list(r.x ORDER BY o, i) FILTER (WHERE r.x IS NOT NULL), []) AS s
          FROM h LEFT JOIN r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
    p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM s),
    q AS (SELECT conv_id, s, depth, list_slice(s, 1, depth) AS k FROM p),
    n AS (SELECT k, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            string_agg(CASE WHEN len(s) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM q GROUP BY k),
    w AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(k[depth].t, '[^ \t\n\x0B\f\r]+')) END AS own,
            NOT EXISTS (SELECT 1 FROM n c WHERE c.depth = n.depth + 1 AND list_slice(c.k, 1, n.depth) = n.k) AS leaf FROM n),
    b AS (SELECT a.k, CAST(sum(d.own) AS BIGINT) AS saved_tokens, CAST(sum(d.leaf::INT) AS BIGINT) AS n_leaves,
            count(*) FILTER (d.depth = a.depth + 1) AS n_children
          FROM w a JOIN w d ON list_slice(d.k, 1, a.depth) = a.k GROUP BY a.k)
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens,
           sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM n JOIN b ON b.k = n.k LEFT JOIN n u ON n.depth > 0 AND u.k = list_slice(n.k, 1, n.depth - 1)""")
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    nodes = prefix_trie.prefix_trie(table(spark, folder, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# Every pair within the threshold: the index may miss some of them.
@question("""
    WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    g AS (SELECT row_number() OVER () AS r, vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v
          WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0),
    l AS (SELECT a.r, b.r AS s, a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.r <> b.r AND len(a.v) = len(b.v)
          AND list_inner_product(a.v, b.v) >= 0.9 * a.n * b.n),
    c AS (SELECT r, s, y FROM l UNION SELECT c.r, l.s, l.y FROM c JOIN l ON c.s = l.r),
    m AS (SELECT r, min(y) AS least FROM c GROUP BY r),
    k AS (SELECT r, count(*) AS n FROM l GROUP BY r)
    SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id,
           vec_id = least(vec_id, coalesce(m.least, vec_id)) AS kept
    FROM g LEFT JOIN m USING (r) LEFT JOIN k USING (r)
    UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM g)""")
def op13_pivot_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, folder, "embeddings").withColumnRenamed("embedding", "vector"))
