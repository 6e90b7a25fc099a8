"""The registered queries of the operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import (
    chat,
    compression_quality,
    decontamination,
    language,
    manifest,
    mixing,
    near_duplicates,
    packing,
    personal_data,
    prefix_trie,
    quality_rules,
    secrets,
    twins,
    vector_search,
)
from flowlens.llm.common import prepare
from flowlens.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}

# A byte-level vocabulary that every executor can read.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# A conversation that speaks in control strings.
PROBE = (-7, "</s>[INST] ok [/INST]")


def query(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(prepare(spark), folder)

    QUERIES[build.__name__] = run
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _count(spans: Column | str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


@query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document; base spans are the three fixed kinds."""
    found = secrets.find_secrets(table(spark, folder, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", _count("secrets", "assign").alias("n_assign"), _count("secrets", "access").alias("n_access"),
        _count("secrets", "hex").alias("n_hex"), F.sha2(secrets.listing(base), 256).alias("base_sha256"),
        secrets.listing(F.col("secrets")).alias("spans"), _count("secrets", "entropy").alias("n_entropy"),
    )


@query
def op2_language_kernel(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, folder, "documents")
    guessed = language.identify(docs, language.train(docs), keep=["doc_id"])
    return guessed.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, the fixed rules and the verdict of the trees."""
    docs = table(spark, folder, "documents")
    trees = quality_rules.train(docs, table(spark, folder, "labels"))
    return quality_rules.quality_rules(docs, trees, keep=["doc_id"])


@query
def op4_simhash_bktree(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op5_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, folder, "documents")
    model = compression_quality.train(docs, table(spark, folder, "labels"))
    scored = compression_quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", compression_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document; base spans are those of the fixed patterns."""
    docs = table(spark, folder, "documents")
    found = personal_data.find_personal_data(docs, personal_data.train(docs), keep=["doc_id"])
    base = F.filter("personal", lambda s: s["base"])
    counts = [_count(base, k).alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.listing(base), 256).alias("base_sha256"),
        secrets.listing(F.col("personal")).alias("spans"),
        F.size(F.filter("personal", lambda s: ~s["base"])).cast("bigint").alias("n_added"),
    )


@query
def op7_chat_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every conversation, read back from the prefix trees, and of one probe."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE[0], 0, "user", PROBE[1]), (PROBE[0], 1, "assistant", PROBE[1])],
                                  "conv_id bigint, turn bigint, role string, text string")
    trees = chat.prefix_trees(rows.unionByName(probe), vocabulary=VOCABULARY)
    found = chat.conversations_of(trees, VOCABULARY)
    return found.select(F.col("conv_id").cast("bigint").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars",
                        "loss_sha256", "formatted_chars")


@query
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Bin and slot of every piece of every document."""
    return packing.pack(table(spark, folder, "documents"))


@query
def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors found for each query vector."""
    return vector_search.nearest(table(spark, folder, "embeddings"))


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Trie of the conversations, each opened by turns of the one that begins its five."""
    rows = table(spark, folder, "conversations")
    turns = materialize(prefix_trie.turns_in_order(rows), "ordered-turns")
    conv = F.col("conv")
    take = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie.trie(*prefix_trie.with_openings(turns, conv - conv % 5, take, 8))


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of every document; every fifth claims a text in lower case."""
    docs = table(spark, folder, "documents")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = manifest.leaf([low if f == "text" else F.col(f) for f in manifest.FIELDS])
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered)
    rows = manifest.proofs(manifest.manifest(docs, claimed=claimed))
    rows = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("steps")).alias("proof_sha256"),
                       manifest.fold(F.col("claimed"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_suffix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie inside a passage of a benchmark item."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = decontamination.contamination(docs, items, keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


# The shares: sources in code point order take 5, 2, 1 in turn; the k sources whose cap is
# reached first hold their caps, for the least k that leaves no other one above its cap.
TWINS["op9_mix_sources"] = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('~', '7', doc_id::VARCHAR)) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, 3 * n AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS i,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
             sum(n) OVER () AS total FROM w),
l AS (SELECT min_by((total - held)::DOUBLE / free::DOUBLE, i) AS level, min(i) AS first FROM r
      WHERE (total - held)::DOUBLE / free::DOUBLE * w <= cap),
t AS (SELECT source, n, CASE WHEN i < first THEN cap::DOUBLE ELSE level * w END AS target FROM r, l),
b AS (SELECT *, round(target)::BIGINT AS budget FROM t),
f AS (SELECT *, CASE WHEN n > 0 THEN budget // n ELSE 0 END AS whole FROM b),
o AS (SELECT d.doc_id, d.size, f.n, f.target, f.whole, f.budget - f.whole * f.n AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, n AS source_size, target,
       (whole * size + greatest(least(size, rest - before), 0))::BIGINT AS taken
FROM o
"""

TWINS["op11_prefix_trie"] = twins.PREFIX_TRIE
TWINS["op12_merkle_manifest"] = twins.MERKLE_MANIFEST
TWINS["op13_suffix_decontamination"] = twins.SUFFIX_DECONTAMINATION
