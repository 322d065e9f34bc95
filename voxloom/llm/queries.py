"""The ``opN_*`` queries: each operator over its whole table, with the columns
that its contract names. ``SQL`` has the DuckDB equivalents where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import bpe, conversations, decontaminate, epsilon_grid, langid, licenses, mixing, secrets_scan, simhash, spelling, substring, toxicity, winnow
from voxloom.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, radius=2)
    return parts.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def held_out(divisor: int, rest: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == rest


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_edited(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(3, 1).alias("held_out"))
    field = langid.train(docs.where("NOT held_out"))
    return langid.identify(docs, field).select("doc_id", "held_out", "lang_pred", "score")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "license", F.round("coverage", 6).alias("coverage"), "start", "end")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.expr(mixing.TOPIC).alias("topic"), F.expr(mixing.TOKENS).cast("long").alias("tokens"))
    cells = mixing.calibrated(docs, mixing.DIMS, F.col("tokens"))
    return mixing.sample(docs, cells, mixing.DIMS, "doc_id").select("doc_id", *mixing.DIMS, F.round("p", 6).alias("p"), "kept")


def op8_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = epsilon_grid.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets_scan.scan(docs, secrets_scan.train(docs))
    return found.select(F.col("id").alias("doc_id"), "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(
        table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, bpe.digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("id", "doc_id")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_toxicity,
        op3_substring,
        op4_winnow,
        op5_language,
        op6_licenses,
        op7_mixing,
        op8_epsilon_grid,
        op9_secrets,
        op10_byte_bpe,
        op11_decontaminate,
        op12_spelling,
        op13_conversations,
    )
}
SQL: dict[str, str] = {
    "op3_substring": """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM s),
r AS (SELECT doc_id, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, i + o AS j FROM r, range(35) t(o)),
n AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
 sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id)""",
    "op8_epsilon_grid": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS r FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.r > 0 AND b.r > 0 AND list_inner_product(a.e, b.e) / (a.r * b.r) >= 0.9),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
k AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)""",
    "op11_decontaminate": """WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
v AS (SELECT item, least(10, len(w)) AS n, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM v),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT r, i, p.n, item FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM p, (SELECT DISTINCT n FROM q) WHERE i + n - 1 <= len(w)) p JOIN q ON p.n = q.n AND p.k = q.k),
c AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT r, i, n FROM h), range(10) t(o) WHERE o < n GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)""",
    "op7_mixing": f"""WITH {mixing.cells_sql("documents")}
SELECT doc_id, d.source, d.lang, d.topic, round(p, 6) AS p, {mixing.DRAW_SQL} < p AS kept FROM {mixing.JOIN_SQL}""",
}
