"""Registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table and derives the digest columns that are asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.tables import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@register("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 1024 ids, one row per piece."""
    from strata.llm.packing import pack_documents
    pieces = pack_documents(read_table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_50k.json"), end_id=0, cut="space")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "tier", "step_id")


@register("op9_decontamination", """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found))
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows."""
    from strata.llm.decontam import contaminated, scan_contamination
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        contaminated().alias("contaminated"))


@register("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and group of every document."""
    from strata.llm.simhash import near_duplicates
    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@register("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    from strata.llm.common import fold
    from strata.llm.langid import identify
    held_out = fold(F.col("doc_id"), 4) == 2
    found = identify(read_table(spark, sf_dir, "documents"), train=~held_out, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat, nearly or exactly, an earlier line."""
    from strata.llm.line_dedup import dedup_lines
    found = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), max_bits=None, min_letters=1, min_words=1, min_chars=10)
    return found.select("doc_id", "text", "n_removed")


@register("op2_html")
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from strata.llm.html_extract import extract
    return extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op5_wavelet")
def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to wavelet-matrix files and read back from them."""
    from strata.llm.wavelet import read_shards, write_shards
    docs = read_table(spark, sf_dir, "documents")
    files = write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, cut="white", n_bits=16)
    found = read_shards(files, docs.schema["doc_id"].dataType)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op3_vptree")
def op3_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows to every fiftieth one."""
    from strata.llm.vptree import nearest
    return nearest(read_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0, k=5, factor=1.1)


@register("op8_secrets")
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of the secret scan, with the forest's score; values as their hash."""
    from strata.llm.common import fold
    from strata.llm.secrets import scan
    held_out = fold(F.col("doc_id"), 4) == 2
    found = scan(read_table(spark, sf_dir, "documents"), train_on=~held_out)
    return found.select("doc_id", "position", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"),
                        held_out.alias("held_out"), "label", "score", "secret")


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from four fifths of the labelled ones."""
    from strata.llm.common import fold
    from strata.llm.toxicity import learn, toxicity
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = learn(docs, read_table(spark, sf_dir, "labels"), train_on=~held_out)
    return toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@register("op13_word_table")
def op13_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document through the table of distinct words, and its text back through the pieces."""
    from strata.llm.word_table import encode_documents
    found = encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded_col="decoded")
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op12_divergence", """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
cells AS (
  SELECT g.lang, g.source, kept.term, CAST(coalesce(n, 0) AS HUGEINT) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
  FROM cells JOIN v USING (lang)),
whole AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM whole JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
         WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50
""")
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from its language and from the language's other sources."""
    from strata.llm.divergence import source_divergence
    return source_divergence(read_table(spark, sf_dir, "documents"))


@register("op11_trie", """
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT c, count(*) AS len FROM o GROUP BY c),
info AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                                      lambda x, i: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h
  FROM lengths),
turns AS (
  SELECT info.c, d, role, txt FROM info JOIN o ON o.c = info.base AND d <= h
  UNION ALL
  SELECT info.c, d - h + least(h, coalesce(b.len, 0)), role, txt
  FROM info JOIN o USING (c) LEFT JOIN lengths b ON b.c = info.base WHERE d > h),
seqs AS (SELECT info.c, coalesce(list(struct_pack(role := role, txt := txt) ORDER BY d) FILTER (d IS NOT NULL), []) AS t
         FROM info LEFT JOIN turns USING (c) GROUP BY info.c),
p AS (SELECT c, len(t) AS len, d, min(c) OVER (PARTITION BY d, t[1:d]) AS node, octet_length(encode(t[d].txt)) AS bytes
      FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT node, d, count(*) AS n, coalesce(max(bytes), 0) AS bytes,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len = d), '')) AS ends
  FROM p GROUP BY node, d),
linked AS (SELECT nodes.*, up.node AS parent FROM nodes LEFT JOIN p up ON up.c = nodes.node AND up.d = nodes.d - 1),
children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY parent, d),
kids AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN children USING (node, d)),
sums AS (SELECT up.node, up.d, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((k.n - 1) * k.bytes) AS saved
         FROM kids k JOIN p up ON up.c = k.node AND up.d <= k.d GROUP BY up.node, up.d)
SELECT node AS conv_id, CAST(d AS BIGINT) AS depth, CAST(parent AS BIGINT) AS parent_conv_id, n AS n_convs, n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM kids JOIN sums USING (node, d)
""")
def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the regrown conversations."""
    from strata.llm.common import materialise
    from strata.llm.prefix_trie import conversation_trie, order_turns, regrown
    turns = materialise(order_turns(read_table(spark, sf_dir, "conversations")), "turns")
    return conversation_trie(*regrown(turns))
