"""One query per operator, over the whole of its table with production
parameters, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.llm import (
    byte_bpe,
    chunk_pieces,
    curve_packing,
    embedding_dedup,
    hyperplane_tree,
    license_templates,
    quality_pu,
    quality_rules,
    simhash_dedup,
    substring_dedup,
    toxicity_mil,
    url_filter,
    word_runs,
)
from shipledger.llm.common import fold, table


def _predicted(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.withColumns({"held_out": F.coalesce(fold("doc_id", folds) == held, F.lit(False)),
                               "predicted": (F.col("score") >= 0.7).cast("int")})


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_pu.score(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))
    return _predicted(scored, quality_pu.FOLDS, quality_pu.HELD).select("doc_id", "held_out", "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity_mil.score(docs, toxicity_mil.fit(docs, table(spark, sf_dir, "labels")))
    return _predicted(scored, toxicity_mil.FOLDS, toxicity_mil.HELD).select(
        "doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending", "first_offending")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.digest(license_templates.scan(table(spark, sf_dir, "documents")))


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return curve_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(pages))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.groups(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _cycled(docs: DataFrame) -> DataFrame:
    """Documents in which every tenth, by the CRC-32 h of its id, repeats a
    stretch of p words from word a on to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w):
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        # bound by lambdas, so that neither is computed again for each word
        return F.transform(F.array(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p"))), lambda k: F.array_join(
            F.transform(w, lambda x, i: F.when(i < k["a"], x).otherwise(F.get(w, k["a"] + (i - k["a"]) % k["p"]))), " "))[0]

    cycled = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, cycled).otherwise(F.col("text")).alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.detect(_cycled(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("_l", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_l.s")).alias("start"),
        F.col("_l.length").alias("length"), (-F.col("_l.p")).alias("period"),
        F.floor(1000 * F.col("_l.length") / -F.col("_l.p")).alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", label.alias("label"), "embedding", (F.col("vec_id") % 100 == 0).alias("anchor"))
    return hyperplane_tree.mine(rows)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return chunk_pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_quality_classifier, op3_toxicity, op4_license_scan, op5_curve_packing,
    op6_substring_dedup, op7_byte_bpe, op8_url_filter, op9_quality_rules, op10_simhash_near_dedup,
    op11_word_runs, op12_hard_negatives, op13_sentencepiece)}

ORACLE = {
    # all pairs in double precision, then reachability
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v
          UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
component AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN component c ON v.vec_id = c.x LEFT JOIN degree d ON v.vec_id = d.x""",
    # every window against the earliest start of its words
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
        FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 19)) AS i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY k) AS f FROM win)
         WHERE f <> (doc_id, i)),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps
         FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS p FROM late) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word LEFT JOIN gone USING (doc_id)
         WHERE ps IS NULL OR NOT list_contains(ps, p) GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    # every anchor against every row in whole numbers
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT a, b, score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
neg AS (SELECT pos.a, pos.b, pos.score AS positive_score, s.b AS n, s.score AS negative_score,
               row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY s.score DESC, s.b) AS r
        FROM pos JOIN s ON s.a = pos.a AND NOT s.same
          AND 80 * pos.score <= 100 * s.score AND 100 * s.score <= 100 * pos.score)
SELECT a AS anchor_id, b AS positive_id, r::INT AS rank, n AS negative_id, positive_score, negative_score
FROM neg WHERE r <= 5""",
}
