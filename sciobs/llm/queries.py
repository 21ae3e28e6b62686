"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprints, jaccard_join, lexical, licenses, line_dedup, mixing, packing, pii, quality, shared, sharding, topk, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_test(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), topk.whole(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "p_block")


#: Shares of all tokens that the registered mixture aims at.
MIXTURE = {"clean": 0.93, "junk": 0.05, "toxic": 0.02}


def document_domains(labels: DataFrame) -> DataFrame:
    """The labelled table of the mixture: clean, junk (low quality) or toxic documents."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train(docs, document_domains(table(spark, sf_dir, "labels")))
    scored = shared.keep(mixing.with_posteriors(docs, model).select("doc_id", "tokens", "posterior"), "domains")
    total = sum(mixing.domain_tokens(scored, model.domains))
    mixed = mixing.mix(scored, [total * MIXTURE.get(d, 0) for d in model.domains])
    shares = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return mixed.select("doc_id", "tokens", *shares, "rate", "copies")


#: Keeps the registered query repeatable; production reads its key from a secret store.
EXAMPLE_KEY = "sciobs-example-key"


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), EXAMPLE_KEY)
    counts = [F.coalesce(F.try_element_at("private", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return done.select("doc_id", *counts, F.aggregate(F.map_values("private"), F.lit(0), lambda a, b: a + b).cast("long").alias("n_private"), "text")


#: Documents of a directory in the tree that the licence scan sees.
DOCUMENTS_A_DIRECTORY = 50


def document_paths(docs: DataFrame) -> DataFrame:
    """documents have no paths: source / thousands of ids / directories of 50 / file."""
    i = F.col("doc_id")
    return docs.withColumn("path", F.concat_ws("/", "source", F.floor(i / 1000).cast("string"), F.floor(i / DOCUMENTS_A_DIRECTORY).cast("string"), F.concat(i.cast("string"), F.lit(".txt"))))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_paths(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return licenses.scan(docs).select("doc_id", "path", "licence", "cosine", "how", "licence_dir")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op13_aligned_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_soft_mixing": op1_soft_mixing,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_private_data": op4_private_data,
    "op5_url_filter": op5_url_filter,
    "op6_order_minhash": op6_order_minhash,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_license_scan": op8_license_scan,
    "op9_exact_topk": op9_exact_topk,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_ranked_search": op11_ranked_search,
    "op12_jump_shards": op12_jump_shards,
    "op13_aligned_tokenizers": op13_aligned_tokenizers,
}



def _crc_byte(low: str) -> str:
    """SQL of the CRC-32 of one byte, the low one of an expression: each bit counts with its own constant."""
    found = "0"
    for j in range(8):
        c = 1 << j
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        found = f"xor({found}, (({low} >> {j}) & 1) * {c})"
    return found


#: z: what each byte of a CRC-32 becomes after 256 zero bytes.
_CRC_TABLES = f"""z AS MATERIALIZED (
            SELECT list(list_reduce(list_concat([(n & 255) << (8 * (n >> 8))], range(256)), lambda c, k: xor(c >> 8, {_crc_byte("c")})) ORDER BY n) AS z FROM range(1024) AS bytes(n)
        )"""

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": r"""
        WITH rows AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents
        ), lines AS (
            SELECT r, doc_id, id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT r, doc_id, id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM rows)
        ), repeated AS (
            SELECT key, max(id) AS holder FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3
        ), marked AS (
            SELECT r, doc_id, i, line, coalesce(id < holder, false) AS gone FROM lines LEFT JOIN repeated USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY r, doc_id""",
    "op9_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_ranked_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents WHERE text IS NOT NULL
        ), sizes AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0
        ), corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes
        ), asked AS (
            SELECT q, item_id, term, count(*) AS many FROM (
                SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
                FROM (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))
            ) GROUP BY q, item_id, term
        ), found AS (
            SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM found, corpus GROUP BY term, docs
        ), parts AS (
            SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))) AS part FROM found JOIN sizes USING (r) JOIN weights USING (term), corpus
        ), scores AS (
            SELECT q, item_id, r, doc_id, CAST(sum(many * part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY q, item_id, r, doc_id
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op12_jump_shards": f"""
        WITH RECURSIVE {_CRC_TABLES}, d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n,
                   (CAST(coalesce(doc_id, -9223372036854775808) AS HUGEINT) + {2**64}) % {2**64} AS key
            FROM documents
        ), padded AS (
            SELECT r, 256 * ((n + 255) // 256) - n AS pad, unnest(range((n + 255) // 256)) AS k, lpad(hex(encode(text)), CAST(512 * ((n + 255) // 256) AS INTEGER), '0') AS h FROM d
        ), pieces AS (SELECT r, pad, k, substr(h, CAST(512 * k + 1 AS BIGINT), 512) AS h FROM padded
        ), sums AS (
            SELECT r, k, list_reduce(
                list_concat([CAST(0 AS BIGINT)], list_transform(range(256), lambda i: xor(CASE WHEN 256 * k + i - pad BETWEEN 0 AND 3 THEN 255 ELSE 0 END, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)))),
                lambda c, x: xor(c >> 8, {_crc_byte('xor(c, x)')})) AS c FROM pieces
        ), lists AS (SELECT r, list(c ORDER BY k) AS cs FROM sums GROUP BY r
        ), crcs AS (
            SELECT r, xor(4294967295, xor(4294967295 >> (8 * least(n, 4)), coalesce(list_reduce(list_concat([CAST(0 AS BIGINT)], cs),
                lambda a, x: xor(x, xor(xor(z[(a & 255) + 1], z[((a >> 8) & 255) + 257]), xor(z[((a >> 16) & 255) + 513], z[(a >> 24) + 769])))), 0))) AS text_crc32
            FROM d LEFT JOIN lists USING (r), z
        ), jumps AS (
            SELECT r, key, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, 0 AS i FROM d
            UNION ALL
            SELECT r, next, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / CAST((next >> 33) + 1 AS DOUBLE))) AS BIGINT), i + 1
            FROM (SELECT *, (key * {sharding.JUMP} + 1) % {2**64} AS next FROM jumps WHERE j <= {sharding.SHARDS})
        ), found AS (
            SELECT r, max(b) FILTER (b < {sharding.SHARDS}) AS shard, max(b) AS grown_shard, max(CAST(key >> 32 AS BIGINT)) FILTER (i = 1) AS high FROM jumps GROUP BY r
        )
        SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY xor(high, text_crc32), doc_id NULLS FIRST, text_crc32, n) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
        FROM d JOIN crcs USING (r) JOIN found USING (r)""",
}
