"""The queries of the corpus operators over their tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmodel.llm import ann, exact_dedup, jaccard_join, line_dedup, lm, packing, periodic_runs, prefix_trie, quality, sharding, simhash, token_file, word_bpe
from starmodel.llm.common import shared_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    token_file.write_ids(_documents(spark, sf_dir), path)
    return token_file.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(_documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), capacity=1024)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf_dir), size=3, radius=2).select("doc_id", "fingerprint", "component_id")


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = word_bpe.encode_decode(_documents(spark, sf_dir))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.scored(docs, model)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(_documents(spark, sf_dir), shards=8)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_documents(spark, sf_dir), size=5, percent=80)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", periodic_runs.with_periods(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs.digests(periodic_runs.collapse_runs(docs, least=6, power=4))


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_token_file": op2_token_file,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_word_bpe": op6_word_bpe,
    "op7_neighbours": op7_neighbours,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_sharding": op10_sharding,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
}

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: The crc32 of a number's digits, bit by bit.
_CRC = """xor(4294967295, list_reduce([CAST(ascii(x) AS UBIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')],
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)), CAST(4294967295 AS UBIGINT)))"""

ORACLE_SQL = {
    "op3_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM split),
        keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WHITE}) AS key FROM line),
        common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(translate(coalesce(text, ''), {_WHITE}, '')) AS text_sha256 FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
    "op11_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [hash(array_to_string(words, ' '))]
            ELSE list_transform(range(1, len(words) - 3), lambda i: hash(array_to_string(words[i:i + 4], ' '))) END)) AS shingles FROM w),
        cls AS (SELECT shingles, min(doc_id) AS cid, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
        tok AS (SELECT cid, n, unnest(shingles) AS h FROM cls),
        pair AS (SELECT a.cid AS x, b.cid AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common FROM tok a JOIN tok b ON a.h = b.h AND a.cid < b.cid AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL),
        link AS (SELECT x, y FROM pair WHERE 100 * common >= 80 * (nx + ny - common)),
        edge AS (SELECT x AS u, y AS v FROM link UNION SELECT y, x FROM link),
        reach AS (SELECT cid AS u, cid AS v FROM cls UNION SELECT r.u, e.v FROM reach r JOIN edge e ON e.u = r.v),
        root AS (SELECT u, min(v) AS component FROM reach GROUP BY u)
        SELECT s.doc_id, len(s.shingles) AS n_shingles, coalesce(component, s.doc_id) AS component_id FROM s LEFT JOIN cls ON cls.shingles = s.shingles LEFT JOIN root ON u = cid""",
    "op12_prefix_trie": f"""
        WITH turns AS (SELECT conv_id AS c, turn, coalesce(text, '') AS text, sha256(concat(length(coalesce(role, '')), ':', role, text)) AS k FROM conversations WHERE conv_id IS NOT NULL),
        t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos FROM turns),
        ids AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
        u AS (SELECT ids.c, pos, text, k FROM ids JOIN t ON t.c = base AND pos <= h UNION ALL SELECT ids.c, pos, text, k FROM ids JOIN t ON t.c = ids.c AND pos > h),
        path AS (SELECT c, row_number() OVER w AS d, text, sha256(string_agg(k, '') OVER w) AS node FROM u WINDOW w AS (PARTITION BY c ORDER BY pos)
            UNION ALL SELECT c, 0, '', 'root' FROM ids),
        step AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS last FROM path),
        node AS (SELECT node, min(c) AS conv_id, any_value(d) AS depth, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(strlen(text)) AS saved,
            sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM step GROUP BY node),
        n AS (SELECT *, (SELECT count(*) FROM node m WHERE m.up = node.node) AS n_children FROM node),
        below AS (SELECT p.node, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(n.saved) AS saved_tokens FROM n JOIN path p ON p.c = n.conv_id AND p.d <= n.depth GROUP BY p.node)
        SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM n JOIN below USING (node) LEFT JOIN n m ON m.node = n.up""",
}
