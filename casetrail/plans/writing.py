"""Notes, vectors and citations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.functions.vectors import cosine_distance, vector_text
from casetrail.operators import citations, notes, vector_index
from casetrail.plans.registry import question
from casetrail.session import cut, spread
from casetrail.sources import tables

QUESTION = "The customer let another person use the account and moved small deposits out within hours"
K = 10


def hashed(texts: str, key: str, dim: int = 768) -> str:
    """Bucket sums of hashed words and 4-grams, as CTE bodies on a (key, text) relation."""
    return f"""
  SELECT {key}, CAST((('0x' || h[1:16])::UBIGINT::HUGEINT % {dim} * {2 ** 64 % dim}
         + ('0x' || h[17:32])::UBIGINT::HUGEINT % {dim}) % {dim} AS BIGINT) AS bucket,
         CAST(sum(CASE WHEN h[16:16] IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE -1 END) AS BIGINT) AS value
  FROM (SELECT {key}, md5(feature) AS h FROM (
    SELECT {key}, unnest(list_concat(w, flatten(list_transform(w, lambda x: list_transform(
      range(1, CAST(greatest(2, length(x) - 2) AS BIGINT)), lambda i: substr(x, CAST(i AS INTEGER), 4)))))) AS feature
    FROM (SELECT {key}, regexp_extract_all(lower(text), '[a-z]+') AS w FROM {texts})))
  GROUP BY ALL HAVING sum(CASE WHEN h[16:16] IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE -1 END) <> 0"""


def scaled(relation: str, key: str) -> str:
    """Unit length, six decimals, single precision."""
    return f"""
  SELECT {key}, bucket, CAST(CAST(round(value / sqrt(sum(value * value) OVER (PARTITION BY {key})), 6) AS FLOAT)
         AS DOUBLE) AS x FROM {relation}"""


@question("WITH hashed AS (" + hashed("documents", "doc_id") + ") SELECT * FROM hashed", views=False)
def hash_embedding_buckets(spark, folder):
    docs = tables.table(spark, folder, "documents")
    return notes.sparse_hash(docs, "doc_id").select("doc_id", "bucket", F.col("value").cast("bigint").alias("value"))


PENDING_SQL = f"""
WITH waiting AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)),
hashed AS ({hashed("waiting", "doc_id")}),
scaled AS ({scaled("hashed", "doc_id")}),
dense AS (
  SELECT w.doc_id, b.bucket, coalesce(s.x, 0) AS x
  FROM waiting w CROSS JOIN (SELECT unnest(range(768)) AS bucket) b LEFT JOIN scaled s USING (doc_id, bucket))
SELECT doc_id AS note_id, md5('[' || string_agg(printf('%.6f', x), ',' ORDER BY bucket) || ']') AS vector_md5
FROM dense GROUP BY doc_id"""


@question(PENDING_SQL, views=False)
def embed_pending(spark, folder):
    """Documents without a stored vector get one."""
    docs = tables.table(spark, folder, "documents").withColumnRenamed("doc_id", "note_id")
    stored = tables.table(spark, folder, "embeddings").withColumnRenamed("vec_id", "note_id")
    done = notes.embed_pending(docs, stored)
    return done.select("note_id", F.md5(vector_text(F.col("embedding"))).alias("vector_md5"))


@question(f""",
asked AS (SELECT 0 AS q, '{QUESTION}' AS text),
dq AS ({hashed("asked", "q")}), sq AS ({scaled("dq", "q")}),
dn AS ({hashed("notes", "note_id")}), sn AS ({scaled("dn", "note_id")}),
lengths AS (SELECT note_id, sqrt(sum(x * x)) AS n FROM sn GROUP BY note_id),
dots AS (SELECT note_id, sum(sn.x * sq.x) AS d FROM sn JOIN sq USING (bucket) GROUP BY note_id),
away AS (SELECT l.note_id, 0.0 + round(1 - coalesce(d, 0) / (n * (SELECT sqrt(sum(x * x)) FROM sq)), 9) AS distance
         FROM lengths l LEFT JOIN dots USING (note_id))
SELECT note_id, account_id, round(distance, 4) AS distance,
       row_number() OVER (ORDER BY distance, note_id) AS rank
FROM away JOIN notes USING (note_id) QUALIFY rank <= {K}""")
def note_knn(spark, folder):
    """The notes closest to a question, over all whole texts."""
    # Written down: the vectors are counted, compared and joined, and would be made anew for each.
    with_vectors = cut(notes.embed(spread(tables.notes(spark, folder))))
    return notes.search_notes(with_vectors, QUESTION, K).select(
        "note_id", "account_id", "distance", F.col("rank").cast("bigint").alias("rank"))


@question(f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
q AS (SELECT label, arg_min(e, vec_id) AS qe FROM v GROUP BY label),
away AS (SELECT CAST(q.label AS VARCHAR) AS query, vec_id,
         0.0 + round(1 - list_sum(list_transform(list_zip(e, qe), lambda z: z[1] * z[2]))
               / (sqrt(list_sum(list_transform(e, lambda x: x * x)))
                  * sqrt(list_sum(list_transform(qe, lambda x: x * x)))), 9) AS distance FROM v, q)
SELECT query, vec_id, round(distance, 4) AS distance,
       row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank
FROM away QUALIFY rank <= {K}""", views=False)
def vector_knn(spark, folder):
    """For the first vector of every label: its nearest vectors, by the index."""
    vectors = tables.table(spark, folder, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    asked = first.select(F.col("label").cast("string").alias("query"), F.col("e").alias("vector"))
    near = vector_index.search_index(vector_index.build_index(vectors, "vec_id"), asked, K)
    return near.select("query", "vec_id", F.round("distance", 4).alias("distance"),
                       F.col("rank").cast("bigint").alias("rank"))


@question("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
q AS (SELECT label, arg_min(e, vec_id) AS qe FROM v GROUP BY label)
SELECT vec_id, 0.0 + round(1 - list_sum(list_transform(list_zip(e, qe), lambda z: z[1] * z[2]))
       / (sqrt(list_sum(list_transform(e, lambda x: x * x)))
          * sqrt(list_sum(list_transform(qe, lambda x: x * x)))), 6) AS distance
FROM v JOIN q USING (label)""", views=False)
def vector_distance(spark, folder):
    """Distance of every vector to the first vector of its label, by built-in functions."""
    vectors = tables.table(spark, folder, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return vectors.join(first, "label").select(
        "vec_id", (F.lit(0.0) + F.round(cosine_distance(F.col("embedding"), F.col("first")), 6)).alias("distance"))


WORD, LONG_WORD = "[A-Z][a-z]{3,}", "[A-Z][a-z]{7,}"


@question(f""",
said AS (SELECT run_id, arg_max(content, seq) AS answer FROM messages GROUP BY run_id),
cited AS (SELECT DISTINCT run_id, unnest(regexp_extract_all(answer, '{WORD}')) AS id FROM said),
seen AS (SELECT DISTINCT run_id, unnest(regexp_extract_all(content, '{WORD}')) AS id FROM messages WHERE role = 'tool'),
split AS (
  SELECT c.run_id, string_agg(c.id, ',' ORDER BY c.id) AS cited,
         string_agg(c.id, ',' ORDER BY c.id) FILTER (WHERE s.id IS NOT NULL) AS verified,
         string_agg(c.id, ',' ORDER BY c.id) FILTER (WHERE s.id IS NULL) AS unverified
  FROM cited c LEFT JOIN seen s USING (run_id, id) GROUP BY c.run_id)
SELECT run_id, coalesce(cited, '') AS cited, coalesce(verified, '') AS verified,
       coalesce(unverified, '') AS unverified,
       array_to_string(list_sort(list_distinct(regexp_extract_all(answer, '{LONG_WORD}'))), ',') AS accounts,
       'PENDING ANALYST REVIEW' AS status
FROM said LEFT JOIN split USING (run_id)""")
def citation_audit(spark, folder):
    """Capitalised words stand for ids: which of an answer's words were seen earlier in its run?"""
    out = citations.audit(tables.messages(spark, folder), WORD, LONG_WORD)
    return out.select("run_id", F.array_join("cited_evidence", ",").alias("cited"),
                      F.array_join("verified_evidence", ",").alias("verified"),
                      F.array_join("unverified_evidence", ",").alias("unverified"),
                      F.array_join("accounts_mentioned", ",").alias("accounts"), "status")


@question("""
SELECT run_id, CAST(coalesce(sum(tool_calls) FILTER (WHERE role = 'ai'), 0) AS BIGINT) AS tool_calls,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens
FROM messages GROUP BY run_id""")
def transcript_totals(spark, folder):
    return citations.run_totals(tables.messages(spark, folder))
