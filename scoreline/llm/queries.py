"""Registered queries of the training-data operators and their oracle SQL.

Each query applies its operator to the whole of its table and derives the
contract's digest columns from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.llm import ann_lsh, bpe, chat, html_cut, merkle, min_slack, packing, prefix_trie, simhash_vpt, sketch, suffix_dedup, toxicity, url_filter
from scoreline.llm.common import table

#: rules of the URL query: host, path, verdict
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit(CONTROL_TEXT).alias("text"))
    done = chat.format_reply_trees(chat.conversation_messages(rows.unionByName(planted)))
    read = done.select(F.col("leaf.conv_id").alias("conv_id"), "formatted",
                       chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                       F.sha2(joined, 256).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract_main_text(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN, keep_ids=False)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lengths are taken at the scan, so that no text travels to be dropped at the end
    sized = table(spark, sf_dir, "documents").select("doc_id", packing.word_tokens(F.col("text")).alias("words"))
    return packing.pack(sized, F.col("words")).drop("words")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("cut_bytes").alias("n_bytes"),
                      (F.col("cut_bytes") - F.octet_length("cut_kept")).alias("n_removed"),
                      F.size("cut_spans").cast("bigint").alias("n_spans"), F.sha2("cut_kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vpt.near_duplicates(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_lsh.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketch.edited_texts(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       sketch.fingerprint(F.col("sketch")).alias("fingerprint"),
                       sketch.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
                       sketch.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       sketch.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
                       sketch.containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = prefix_trie.turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    conv = F.col("conv")
    said, every = prefix_trie.share_openings(said, 8, conv - conv % 5, F.crc32(conv.cast("string")) % 9)
    return prefix_trie.trie(prefix_trie.stored(said, "trie-rebuilt"), every).drop("turn_id")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    cut = min_slack.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return min_slack.pack(cut)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = merkle.record_hash("doc_id", "source", "lang", F.col("n_chars").cast("decimal(20,0)") + 1, "text")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    # the texts end here: two digests of each go on
    records = docs.select("doc_id", "lang", merkle.record_hash("doc_id", "source", "lang", "n_chars", "text").alias("hash"),
                          F.when(hit, changed).alias("tampered"))
    rows = merkle.manifest(records, F.col("hash"), "doc_id", "lang")
    folded = merkle.fold(F.coalesce(merkle.hex_of(F.col("tampered")), F.col("leaf")), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_html_text": op2_html_text,
    "op3_bpe": op3_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_simhash": op8_simhash,
    "op9_nearest": op9_nearest,
    "op10_fingerprint": op10_fingerprint,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_best_fit": op12_best_fit,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# unsigned CRC-32 of the decimal digits of {x}
_CRC32 = """(SELECT 4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST({x} AS VARCHAR), ''),
   lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
   lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"""


def _fields(*values: str) -> str:
    return " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END" for v in values)


ORACLE = {
    "op1_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g'))
          + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g'))
          + length(role) - length(replace(role, chr(10), ''))
          + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS size
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op4_url_filter": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    # the given pages' own form: article, headings and paragraphs; the operator reads any page
    "op2_html_text": r"""
WITH article AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
blocks AS (
  SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(a, '</?(h1|p)>'), lambda b:
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'),
         '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'),
         '[\s\x{a0}]+', ' ', 'g'))), lambda b: b <> '') AS b
  FROM article)
SELECT page_id, url, array_to_string(b, chr(10)) AS text, cast(length(array_to_string(b, chr(10))) AS bigint) AS n_chars
FROM blocks""",
    "op11_prefix_trie": f"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS said
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
opening AS (SELECT *, {_CRC32.format(x="conv_id")} % 9 AS h FROM own),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.said[1:o.h], []), o.said[o.h + 1:]) AS said
  FROM opening o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
prefixes AS (SELECT conv_id AS conv, len(said) AS size, unnest(range(0, len(said) + 1)) AS depth, said FROM rebuilt),
members AS (
  SELECT conv, size, depth, said[depth].t AS last, min(conv) OVER (PARTITION BY depth, said[1:depth]) AS node FROM prefixes),
nodes AS (
  SELECT m.node AS conv_id, m.depth, min(p.node) AS parent_conv_id, count(*) AS n_convs,
         CASE WHEN m.depth = 0 THEN 0 ELSE (count(*) - 1) * min(strlen(m.last)) END AS worth,
         sha256(coalesce(string_agg(CAST(m.conv AS VARCHAR), ',' ORDER BY m.conv) FILTER (WHERE m.size = m.depth), '')) AS ends_sha256
  FROM members m LEFT JOIN members p ON p.conv = m.conv AND p.depth = m.depth - 1 GROUP BY m.node, m.depth),
counted AS (
  SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.parent_conv_id = n.conv_id) AS n_children FROM nodes n),
above AS (
  SELECT m.node AS conv_id, m.depth, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(u.worth) AS saved
  FROM counted u JOIN members m ON m.conv = u.conv_id AND m.depth <= u.depth GROUP BY m.node, m.depth)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, c.parent_conv_id, c.n_convs, c.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
       CAST(a.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN above a ON a.conv_id = c.conv_id AND a.depth = c.depth""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_fields("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {_CRC32.format(x="doc_id")} % 7 = 0
              THEN sha256({_fields("doc_id", "source", "lang", "(n_chars + 1)", "text")}) END AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
tree AS (
  SELECT lang, 0 AS lvl, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, lvl + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(nodes[k + 1] || coalesce(nodes[k + 2], '')))
  FROM tree WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j FROM tree WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS lvl, list(subroot ORDER BY j) AS nodes FROM subroots
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(nodes[k + 1] || coalesce(nodes[k + 2], '')))
  FROM top WHERE len(nodes) > 1),
walk AS (
  SELECT doc_id, lang, leaf, 0 AS lvl, i, '' AS proof, coalesce(tampered, leaf) AS folded FROM placed
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.lvl + 1, w.i // 2, w.proof || coalesce(t.nodes[xor(w.i, 1) + 1], ''),
         sha256(CASE WHEN w.i % 2 = 1 THEN t.nodes[w.i] ELSE '' END || w.folded || CASE WHEN w.i % 2 = 0 THEN coalesce(t.nodes[w.i + 2], '') ELSE '' END)
  FROM walk w JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.lvl = w.lvl AND len(t.nodes) > 1),
climbed AS (
  SELECT w.doc_id, w.leaf, s.subroot, s.j, w.proof, w.folded
  FROM walk w JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.lvl = w.lvl AND len(t.nodes) = 1
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang),
upward AS (
  SELECT doc_id, leaf, subroot, 0 AS lvl, j AS i, proof, folded FROM climbed
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.lvl + 1, w.i // 2, w.proof || coalesce(t.nodes[xor(w.i, 1) + 1], ''),
         sha256(CASE WHEN w.i % 2 = 1 THEN t.nodes[w.i] ELSE '' END || w.folded || CASE WHEN w.i % 2 = 0 THEN coalesce(t.nodes[w.i + 2], '') ELSE '' END)
  FROM upward w JOIN top t ON t.lvl = w.lvl AND len(t.nodes) > 1)
SELECT u.doc_id, u.leaf, u.subroot, t.nodes[1] AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = t.nodes[1] AS verified
FROM upward u JOIN top t ON t.lvl = u.lvl AND len(t.nodes) = 1""",
}
