"""One query per operator over its whole table, in the digest form of its contract, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtable.llm import decontaminate, exact, hmm, huffman, language_id, packing, pii, prefix_counts, prefix_trie, simhash, token_alignment, topk_search, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_hidden_markov")
def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_corpus(table(spark, sf_dir, "documents"))


@query("op2_huffman")
def op2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.code_corpus(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.count_corpus(table(spark, sf_dir, "documents"))


@query(
    "op4_exact_dedup",
    r"""WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM t""",
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), sha=True)


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


WORD_SQL = r"regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"


@query(
    "op7_decontamination",
    f"""WITH d AS (SELECT doc_id, {WORD_SQL} AS w FROM documents),
    b AS (SELECT item_id, {WORD_SQL} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
    m AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN bw USING (win)),
    h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
    i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM m GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs))


@query("op9_personal_data")
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query(
    "op11_top_k",
    """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
    FROM (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w) AS score,
                 row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.w, c.w) DESC, c.vec_id NULLS LAST) AS rank
          FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0) WHERE rank <= 20""",
)
def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_corpus(table(spark, sf_dir, "documents"))


#: crc32 of a number's digits, bit by bit.
CRC_SQL = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@query(
    "op13_prefix_trie",
    f"""WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
              FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, {CRC_SQL} % 9 AS h, conv_id - conv_id % 5 AS source FROM (SELECT DISTINCT conv_id FROM o)),
    t AS (SELECT c.conv_id, 0 AS part, o.p, o.role, o.text FROM c JOIN o ON o.conv_id = c.source AND o.p <= c.h
          UNION ALL SELECT c.conv_id, 1, o.p, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.p > c.h),
    s AS (SELECT conv_id, coalesce(q, []) AS q FROM c LEFT JOIN (SELECT conv_id, list(struct_pack(role, text) ORDER BY part, p) AS q FROM t GROUP BY conv_id) USING (conv_id)),
    x AS (SELECT conv_id, d, q[1:d] AS k, len(q) = d AS ends FROM (SELECT conv_id, q, unnest(range(0, len(q) + 1)) AS d FROM s)),
    n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS e,
                 CASE WHEN d = 0 THEN 0 ELSE strlen(k[-1].text) END AS b FROM x GROUP BY k, d),
    kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
    f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k, d)),
    a AS (SELECT x.k, x.d, sum((f.n_convs - 1) * f.b) AS saved, count(*) FILTER (f.n_children = 0) AS n_leaves FROM f JOIN x ON x.conv_id = f.conv_id AND x.d <= f.d GROUP BY x.k, x.d)
    SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(f.e) AS ends_sha256
    FROM f JOIN a ON a.k = f.k AND a.d = f.d LEFT JOIN n p ON p.d = f.d - 1 AND p.k = f.k[1:f.d - 1]""",
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))
