"""The registered queries of this subpackage over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourgrid.llm import alignment, chunks, extract, idstore, lexical, mixing, neardup, packing, pii, quality, rules, shards, topk
from hourgrid.llm.scratch import bound_batches

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """The fifth of the documents whose labels no model sees."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out())


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages"), extract.fit_weights(extract.labelled_pages()))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = rules.fit_rules(docs, training_labels(_table(spark, sf_dir, "labels")))
    return rules.judge(docs, trees)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document that holds a passage which other documents hold too."""
    found = chunks.repeated_passages(_table(spark, sf_dir, "documents"))
    span = F.struct("start", "end", "first_doc_id", "kept")
    docs = found.groupBy("doc_id").agg(F.count_distinct("run").alias("n_passages"), F.sum(F.col("end") - F.col("start")).alias("repeated_chars"),
                                       F.sum(F.when(F.col("kept"), 0).otherwise(F.col("end") - F.col("start"))).alias("dropped_chars"),
                                       F.sort_array(F.collect_list(span)).alias("s"))
    text = F.transform("s", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["first_doc_id"].cast("string")))
    return docs.select("doc_id", "n_passages", "repeated_chars", "dropped_chars", F.array_join(text, ",").alias("passages"))


def _base_of(kind: str, span: Column) -> Column:
    return span["base"] & (span["kind"] == kind)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"), pii.fit_field(pii.labelled_examples()))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", partial(_base_of, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, training_labels(_table(spark, sf_dir, "labels")))
    scored = quality.classify(docs, model)
    return scored.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))


def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(_table(spark, sf_dir, "documents"))


def op10_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents")).documents


def op13_perfect_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return idstore.read_ids(spark, idstore.write_ids(docs), docs).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Query] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_rules": op3_quality_rules,
    "op4_feistel_sharding": op4_feistel_sharding,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_personal_data": op6_personal_data,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_best_two_fit_packing": op10_best_two_fit_packing,
    "op11_lexical_search": op11_lexical_search,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_perfect_hash_ids": op13_perfect_hash_ids,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
              FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
    """,
    "op11_lexical_search": r"""
        WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        d AS (SELECT row_number() OVER () AS document, doc_id, words, CAST(len(words) AS BIGINT) AS n FROM words WHERE len(words) > 0),
        total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
        tf AS (SELECT document, term, count(*) AS tf FROM (SELECT document, unnest(words) AS term FROM d) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        item AS (SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                 FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
        asked AS (SELECT item, item_id, term, count(*) AS repeats FROM item GROUP BY ALL),
        impact AS (SELECT tf.document, tf.term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * d.n * total.docs) // total.terms)) AS impact,
                          CAST(floor(1000 * ln(CAST(2 * total.docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
                   FROM tf JOIN d USING (document) JOIN df USING (term) CROSS JOIN total WHERE tf.term IN (SELECT term FROM asked)),
        scored AS (SELECT item, any_value(item_id) AS item_id, document, CAST(sum(repeats * w * impact) AS BIGINT) AS score
                   FROM asked JOIN impact USING (term) GROUP BY item, document),
        ranked AS (SELECT s.*, d.doc_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, d.doc_id) AS r FROM scored s JOIN d USING (document) WHERE score > 0)
        SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 20
    """,
}
