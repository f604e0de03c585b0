"""Registered queries of the operators, and DuckDB SQL where SQL can state them on whole tables."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import functions as F

from tabwise.llm import bpe, chat, convtrie, decontaminate, embeddings, langid, ngram_lm, sharding, simhash, topk, toxicity, variants, warc
from tabwise.llm.common import ship_package
from tabwise.sources.tables import read_table


def _crc_of_id(n):
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def _crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, four bits at a time."""
    table = []
    for t in range(16):
        for _ in range(4):
            t = (t >> 1) ^ 0xEDB88320 if t & 1 else t >> 1
        table.append(t)
    nibbles = f"list_filter(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: x <> '')"
    return f"""xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform({nibbles}, lambda x: strpos('0123456789ABCDEF', x) - 1),
    lambda a, e: xor(a >> 4, {table}[xor(a & 15, e) + 1])), 4294967295)"""


QUERIES = {}
ORACLES = {}


def _query(f):
    @wraps(f)
    def run(spark, sf_dir):
        ship_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@_query
def op1_sharding(spark, sf):
    plan = sharding.assign_shards(read_table(spark, sf, "documents"), 8)
    return plan.select(F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                       "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLES["op1_sharding"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents
), placed AS (
  SELECT *, sum(size) OVER o - size AS before, sum(size) OVER () AS total FROM d
  WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)
), cut AS (SELECT *, CAST(before * 8 // total AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut"""


@_query
def op2_decontamination(spark, sf):
    found = decontaminate.leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"), short=True)
    return found.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


@_query
def op3_ngram_lm(spark, sf):
    documents = read_table(spark, sf, "documents")
    held_out = F.coalesce(_crc_of_id(7) == 2, F.lit(False))
    scored = ngram_lm.score(documents, ngram_lm.fit(documents.where(~held_out), order=3)).withColumnRenamed("key", "doc_id")
    return scored.withColumn("held_out", held_out)


@_query
def op4_byte_bpe(spark, sf):
    ids = bpe.encode_documents(read_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN, decode=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op5_simhash(spark, sf):
    found = simhash.near_duplicates(read_table(spark, sf, "documents"), words=3, most_bits=3)
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@_query
def op6_language_id(spark, sf):
    documents = read_table(spark, sf, "documents")
    held_out = F.coalesce(_crc_of_id(3) == 1, F.lit(False))
    found = langid.identify(documents, langid.fit(documents.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@_query
def op7_embeddings(spark, sf):
    found = embeddings.near_duplicates(read_table(spark, sf, "embeddings"), 0.93)
    return found.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


ORACLES["op7_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(x, lambda c: c <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), class AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT class.vec_id, coalesce(n.n_links, 0) AS n_links, component_id, class.vec_id = component_id AS kept
FROM class LEFT JOIN n ON class.vec_id = n.vec_id"""


@_query
def op8_chat_formatting(spark, sf):
    said = "</s>[INST] ok [/INST]"
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_chats(chat.log_of_turns(turns.unionByName(more))))


ORACLES["op8_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), each_turn AS (
  SELECT *, '<|' || replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '[', '\o'), '|', '\p') || '|>' || chr(10)
    || replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\o') || '<|end|>' || chr(10) AS segment FROM turns
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
  FROM each_turn GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars FROM whole"""


@_query
def op9_toxicity(spark, sf):
    documents, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    held_out = _crc_of_id(5) == 0
    learn = documents.where(~held_out).select("doc_id", "text").join(
        labels.select("doc_id", F.col("toxic").alias("label")), "doc_id")
    scored = toxicity.score(documents, toxicity.fit(learn)).withColumnRenamed("key", "doc_id")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op10_warc(spark, sf):
    index = warc.write_archives(read_table(spark, sf, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op10_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT hex, max(page_id) AS holder FROM p GROUP BY hex
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(p.hex, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM p JOIN g ON p.hex = g.hex"""


@_query
def op11_prefix_trie(spark, sf):
    turns = convtrie.numbered_turns(read_table(spark, sf, "conversations"))
    return convtrie.prefix_trie(convtrie.rebuilt(turns)).withColumnRenamed("saved_bytes", "saved_tokens")


ORACLES["op11_prefix_trie"] = f"""
WITH said AS (
  SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(digest, 32)) AS place FROM said
), ids AS (
  SELECT conv_id, {_crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM own)
), plan AS (
  SELECT ids.*, least(h, (SELECT count(*) FROM own WHERE own.conv_id = ids.base)) AS taken FROM ids
), turns AS (
  SELECT plan.conv_id, place - h + taken AS d, digest, bytes FROM plan JOIN own ON own.conv_id = plan.conv_id AND place > h
  UNION ALL SELECT plan.conv_id, place, digest, bytes FROM plan JOIN own ON own.conv_id = plan.base AND place <= taken
), paths AS (
  SELECT conv_id, d, bytes, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM plan
), lengths AS (SELECT conv_id, max(d) AS l FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(d) AS depth, any_value(bytes) AS bytes, min(paths.conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(paths.conv_id AS VARCHAR), ',' ORDER BY paths.conv_id) FILTER (WHERE d = l), '') AS ends
  FROM paths JOIN lengths USING (conv_id) GROUP BY path
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND left(c.path, length(c.path) - 64) = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)
)
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, CAST(count(*) FILTER (WHERE b.n_children = 0) AS BIGINT) AS n_leaves,
  CAST(sum((b.n_convs - 1) * b.bytes) AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM linked a JOIN linked b ON starts_with(b.path, a.path)
GROUP BY a.path, a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends"""


@_query
def op12_spelling_variants(spark, sf):
    return variants.group_variants(variants.count_words(read_table(spark, sf, "documents")))


ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT run, c, {_crc_sql("doc_id || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY 1, 2)
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON cut.rest = words.word
), best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(less := -m, other := other)) AS b FROM near GROUP BY word
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * n THEN b.other END AS form,
    CASE WHEN -b.less >= 2 * n THEN -b.less END AS form_n FROM words LEFT JOIN best USING (word)
), up AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT up.word, forms.form FROM up JOIN forms ON up.at = forms.word WHERE forms.form IS NOT NULL
)
SELECT forms.word, forms.form, up.at AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN up ON up.word = forms.word JOIN forms last ON last.word = up.at AND last.form IS NULL"""


@_query
def op13_exact_topk(spark, sf):
    found = topk.top_k(read_table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


ORACLES["op13_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS code FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.code, c.code) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20"""
