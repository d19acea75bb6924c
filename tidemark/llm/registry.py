"""Queries over the driver's tables, one for each operator, and SQL where SQL can express them.

The digests that a query returns are derived here from its operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, edits, fim, licenses, mixing, naming, packing, pivots, ppm, quality, simhash, trie, warc
from tidemark.llm.common import documents, folder

RANKS = "byte_bpe_50k.tiktoken"


def rank_file(name: str = RANKS) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.shard(documents(spark, sf_dir), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), min_cosine=0.93)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), n=3, max_bits=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return ppm.score(documents(spark, sf_dir), F.coalesce(held_out, F.lit(False)))


def masking_edits(text: str) -> list[edits.Edit]:
    """The production edits: e-mail addresses and runs of at least six digits are masked."""
    return edits.masks(text, [(r"[\w.+-]+@[\w-]+\.[\w.-]+", "[email]"), (r"\d{6,}", "[number]")])


def op6_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edits.recount(documents(spark, sf_dir), masking_edits, rank_file(), split_pattern())
    return found.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded", F.sha2("edited", 256).alias("edited_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, targets = mixing.copies(documents(spark, sf_dir))
    each = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    return each.join(targets, "source_no").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_groups(documents(spark, sf_dir))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("target"))
    return quality.classify(documents(spark, sf_dir), labels).withColumnRenamed("selected", "kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir), rank_file(), split_pattern(), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(documents(spark, sf_dir), seed=1, percent=90, spm_percent=20)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, u,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP12_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list_reduce(list_concat([4294967295], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k, 1)))), lambda crc, b:
    list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM (SELECT DISTINCT conv_id FROM t)
), h AS (SELECT conv_id AS c, xor(crc, 4294967295) % 9 AS h FROM convs), turns AS (
  SELECT c, 0 AS own, i, role, text FROM h JOIN t ON t.conv_id = c - c % 5 AND i < h UNION ALL SELECT c, 1, i, role, text FROM h JOIN t ON t.conv_id = c AND i >= h
), whole AS (
  SELECT h.c, coalesce(list({'role': role, 'text': text} ORDER BY own, i) FILTER (role IS NOT NULL), []) AS s FROM h LEFT JOIN turns x ON h.c = x.c GROUP BY h.c
), members AS (SELECT c, d, s[1:d] AS p, d = len(s) AS ends FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM whole)), nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ended,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].text) END AS saved FROM members GROUP BY p, d
), shown AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes x WHERE x.d = n.d + 1 AND x.p[1:n.d] = n.p) AS n_children FROM nodes n LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.p[1:n.d - 1])
SELECT a.conv_id, a.d AS depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
  count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens, sha256(any_value(a.ended)) AS ends_sha256
FROM shown a JOIN shown b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY a.conv_id, a.d
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = warc.read(warc.write(pages, folder(spark, "warc")), payloads=False)
    return found.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"))


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, list_transform(range(4), lambda k: ('0x' || hex[10 * k + 1:10 * k + 10])::BIGINT) AS v FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v[k // 8 + 1] >> (5 * (7 - k % 8))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_pivots": op2_pivots,
    "op3_licenses": op3_licenses,
    "op4_simhash": op4_simhash,
    "op5_ppm": op5_ppm,
    "op6_edits": op6_edits,
    "op7_mixing": op7_mixing,
    "op8_naming": op8_naming,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "op11_fim": op11_fim,
    "op12_trie": op12_trie,
    "op13_warc": op13_warc,
}

OP2_SQL = """
WITH RECURSIVE fit AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.w, r.root FROM reach r JOIN links l ON l.u = r.vec_id
), roots AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.u = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON r.vec_id = e.vec_id
"""

ORACLES: dict[str, str] = {"op2_pivots": OP2_SQL, "op8_naming": OP8_SQL, "op11_fim": OP11_SQL, "op12_trie": OP12_SQL, "op13_warc": OP13_SQL}
