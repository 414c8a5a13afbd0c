"""The operators' queries with production parameters over whole tables, and the SQL that checks them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import let_workers_import, table
from . import bpe, chat, language_id, lexical_search, lm_score, minhash, packing, periodic, quality, suffix_dedup, url_filter, vector_join, vector_search


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 1024 tokens; a digest of each piece's ids."""
    let_workers_import(spark)
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of ids and bytes."""
    let_workers_import(spark)
    both = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return both.select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: The rules of the URL query: verdict, host, path.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and survivors of all embeddings of equal label at cosine 0.98."""
    let_workers_import(spark)
    return vector_join.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vector whose id is divisible by 20."""
    let_workers_import(spark)
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one that holds control strings, formatted and read back."""
    let_workers_import(spark)
    hard = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    out = chat.format_records(chat.conversation_records(rows))
    return out.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(turns, x -> concat(x.role, '\n', x.text, '\n')), '')"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page URL."""
    let_workers_import(spark)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under a model of the documents outside the held-out fold."""
    let_workers_import(spark)
    return lm_score.score_documents(table(spark, sf_dir, "documents"), held_out_fold=1)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies among all documents: five words, similarity 0.8."""
    let_workers_import(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, size=5)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned outside the held-out fold."""
    let_workers_import(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", quality.is_fold(F.col("doc_id"), 0).alias("held_out"))
    return quality.score_documents(rows, model, cut=0.3).drop("text")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 100 bytes."""
    let_workers_import(spark)
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places that the words of every tenth text are read from, so that its end repeats with a period drawn from its id."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods or more among the words of every document, and its text without their repeats."""
    let_workers_import(spark)
    out = periodic.collapse_runs(table(spark, sf_dir, "documents"), least=6, factor=4, order=planted_order)
    best = F.expr("aggregate(runs, get(runs, 0), (a, x) -> if(x.length * a.period > a.length * x.period, x, a))")
    return out.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out fold."""
    let_workers_import(spark)
    docs = table(spark, sf_dir, "documents")
    net = language_id.train(docs, fold=2, folds=4)
    rows = docs.select(F.col("doc_id").cast("long"), "text", quality.is_fold(F.col("doc_id"), 2, 4).alias("held_out"))
    return language_id.predict_languages(rows, net).drop("text")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    let_workers_import(spark)
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"), k=50)


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.n AS an, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.n <> b.n
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.an = v.n) AS n_links, c.component_id,
  v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id
"""

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""

OP5_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '(\\\\|\\[INST\\]|\\[/INST\\]|</s>|\\[ROLE\\]|\\[/ROLE\\]|\\[TEXT\\])', '#\\1', 'g')) AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 19 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP8_SQL = """
WITH rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path,
  (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
FROM u
"""

OP11_SQL = r"""
WITH crcs AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS h
  FROM documents, crcs
), s AS (
  SELECT r, doc_id, words, len(words) AS n, coalesce(h % 10 = 0 AND len(words) > 0, false) AS planted,
    (h // 10) % greatest(len(words), 1) AS a, 3 + (h // 10) % 8 AS k FROM d
), w AS (
  SELECT r, i, words[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // k) ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM s)
), same AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND x.i < y.i
), stretch AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT r, i, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM same) GROUP BY r, q, g
), long AS (SELECT * FROM stretch WHERE length >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM long b WHERE NOT EXISTS (
    SELECT 1 FROM long c WHERE c.r = b.r AND c.q < b.q AND c.start <= b.start AND c.start + c.length >= b.start + b.length)
), best AS (
  SELECT * FROM runs b WHERE NOT EXISTS (
    SELECT 1 FROM runs c WHERE c.r = b.r AND (c.length * b.q > b.length * c.q OR (c.length * b.q = b.length * c.q AND (c.start, c.q) < (b.start, b.q))))
), texts AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t FROM runs GROUP BY r
), dropped AS (
  SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN dropped USING (r, i) GROUP BY r
)
SELECT s.doc_id, coalesce(texts.n_runs, 0) AS n_runs, best.start, best.length, best.q AS period, 1000 * best.length // best.q AS exponent_milli,
  sha256(coalesce(texts.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM s LEFT JOIN best USING (r) LEFT JOIN texts USING (r) LEFT JOIN kept USING (r)
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), held AS (SELECT r, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
sums AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM held),
tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), sums
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scores AS (
  SELECT a.item_id, t.r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked a JOIN tfs t USING (term) JOIN weights USING (term) JOIN held USING (r), sums GROUP BY a.item_id, t.r
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scores JOIN held USING (r) WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_topk_search": op3_topk_search,
        "op4_lm_score": op4_lm_score,
        "op5_chat_format": op5_chat_format,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_url_filter": op8_url_filter,
        "op9_quality": op9_quality,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_language_id": op12_language_id,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": OP2_SQL,
        "op3_topk_search": OP3_SQL,
        "op5_chat_format": OP5_SQL,
        "op8_url_filter": OP8_SQL,
        "op11_periodic_runs": OP11_SQL,
        "op13_lexical_search": OP13_SQL,
    }
