"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import quality_classifier, quality_rules
from .common import documents
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .minhash import near_duplicates
from .mixing import mix
from .packing import byte_bpe, pack, pieces
from .secrets import find_secrets, learn
from .substring_dedup import substring_dedup
from .toxicity import score_toxicity, train


def op1_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup(documents(spark, sf_dir))


def op3_line_dedup(spark, sf_dir):
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op4_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality_rules.quality_rules(docs, quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality_classifier.grade(docs, quality_classifier.train(docs, quality_classifier.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir), keep="largest")


def gpt_encoder():
    import public_tokenizers as P

    return byte_bpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op6_best_fit_packing(spark, sf_dir):
    return pack(pieces(documents(spark, sf_dir), gpt_encoder()))


def op10_secret_scan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = find_secrets(docs, learn(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"] != "format")
    return found.select("doc_id", *(count(k) for k in ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.size(F.filter("found", lambda s: s["kind"] == "format")).cast("long").alias("n_format"))


def op7_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), words=3, num=85).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_source_mix(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op1_toxicity": op1_toxicity,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op10_secret_scan": op10_secret_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op9_source_mix": op9_source_mix,
}

ORACLE_SQL = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op9_source_mix": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS most FROM s),
        l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / (sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
        f AS (SELECT level FROM l WHERE NOT most <= level * w ORDER BY most / w, source NULLS LAST LIMIT 1),
        t AS (SELECT source, source_size, CASE WHEN most <= l.level * w THEN most ELSE (SELECT level FROM f) * w END AS target FROM l),
        r AS (SELECT d.doc_id, d.size, t.source_size, t.target, (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1)::DOUBLE AS rank,
                     CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                     ('0x' || substr(md5('7:' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (floor((rank + 1) * rate + off) - floor(rank * rate + off))::BIGINT * size AS taken FROM r""",
}
