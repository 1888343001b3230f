"""The registered queries of this subpackage: each applies one operator to its whole table and derives the
digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstar.llm import (bpe, decontaminate, embeddings, licenses, lines, negatives, phrases, pii, quality, secrets,
                          sharding, simhash, substring)

#: Phrases a language that the collocation query reports.
FIRST_PHRASES = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    rules = secrets.BASE + secrets.MORE
    out = secrets.scan(table(spark, sf_dir, "documents"), rules)
    base = F.filter("found", lambda x: x["k"] < len(secrets.BASE))
    counts = [F.size(F.expr(f"filter(found, x -> x.k = {i})")).cast("long").alias(f"n_{r.kind}")
              for i, r in enumerate(secrets.BASE)]
    return out.select("doc_id", *counts, F.sha2(secrets.joined(base, rules), 256).alias("base_sha256"),
                      secrets.joined(F.col("found"), rules).alias("spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a window which also starts earlier covers are removed."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in an occurrence of a benchmark window."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept and dropped of every document, its source being the site."""
    out = lines.counted(table(spark, sf_dir, "documents"), F.col("source"))
    return out.select("doc_id", F.col("source").alias("host"), F.col("__n_lines").alias("n_lines"),
                      F.col("__n_dropped").alias("n_dropped"),
                      F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = sharding.histogram_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    out = bpe.round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    out = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE_KINDS))
    counts = [F.size(F.expr(f"filter(spans, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}")
              for k in pii.BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"),
                      pii.joined(F.col("spans")).alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    out = quality.with_score(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")), "score")
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    out = licenses.scan(table(spark, sf_dir, "documents"))
    starts, base = F.col("places.start"), F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_union("places.label", "notices.label"))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("notices.share"), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
                      F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                      F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
                      score.alias("score"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest collocations of each language."""
    out = phrases.ranked(phrases.collocations(table(spark, sf_dir, "documents")), FIRST_PHRASES)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_substring_dedup, op3_benchmark_decontamination, op4_line_dedup, op5_sharding, op6_embedding_near_dedup, op7_byte_bpe, op8_pii, op9_simhash,
    op10_quality_classifier, op11_license_scans, op12_phrase_collocations, op13_hard_negatives)}
_SPACE = r"[^\x20\x09-\x0D]+"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS ws FROM documents),
starts AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s
           FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k
                                 FROM starts) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY word.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS ws
           FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS ws FROM benchmark),
strings AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS s
            FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
                  FROM b WHERE len(ws) > 0)),
places AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS s
           FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
                 FROM d, (SELECT DISTINCT n FROM strings) WHERE len(ws) >= n)),
found AS (SELECT doc_id, item, n, i FROM places JOIN strings USING (n, s)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found)
        GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Exact links. The operator's windows hold whole labels while a label has no more vectors than a window, as at the
# scale of the correctness check; recall on larger tables is measured in tests/llm.
EMBEDDINGS_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {embeddings.COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least_id AS component_id, vec_id = least_id AS kept
FROM (SELECT a AS vec_id, min(b) AS least_id FROM reach GROUP BY a)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""

#: DuckDB SQL by query. The others can't be expressed: op5 (CRC-32), op7 (tokenizer), op8 (the field's spans), op9
#: (XXH64 with a seed), op10 (fitted model) and the pipeline are held against brute force or held-out rows in tests.
SQL: dict[str, str] = {
    "op1_secret_scans": secrets.oracle_sql(), "op2_substring_dedup": SUBSTRING_SQL,
    "op3_benchmark_decontamination": DECONTAMINATION_SQL, "op4_line_dedup": lines.oracle_sql(),
    "op6_embedding_near_dedup": EMBEDDINGS_SQL, "op11_license_scans": licenses.oracle_sql(),
    "op12_phrase_collocations": phrases.oracle_sql(FIRST_PHRASES), "op13_hard_negatives": negatives.ORACLE_SQL,
}
