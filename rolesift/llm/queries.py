"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm import (common, conversation_trie, decontaminate, jaccard, licenses,
                          line_dedup, packing, piece_codec, pseudo_lm, quality, token_alignment,
                          token_counts, token_files, warc)

QUERIES = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.score(docs, quality.fit(docs, labels)).withColumn("llr", F.round("llr", 6))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_texts(table(spark, sf_dir, "documents"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_round_trip(table(spark, sf_dir, "pages")).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        "refers_to")


ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
f AS (SELECT html, MIN(page_id) AS original FROM p GROUP BY html),
s AS (SELECT page_id, original, strlen(p.html) AS n, array_to_string(list_transform(
        string_split(sha1(p.html), ''),
        lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits
      FROM p JOIN f USING (html))
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5),
         lambda j: CAST(substr(bits, 1 + 5 * i + j, 1) AS INT) * (16 >> CAST(j AS INT)))) AS INT),
         1)), '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM s
"""


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.find(docs, items).withColumn("score", F.round("score", 6))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.remove(docs.select("doc_id", "text"))
    return kept.select("doc_id", F.size(line_dedup.lines(F.col("text"))).alias("n_lines"),
                       F.octet_length("text").cast("long").alias("n_bytes"),
                       F.md5("text").alias("text_md5"))


#: Documents as files: a directory per source, language and block of ids. A document that opens
#: with a notice is the licence file of its block or sub-block.
DOCUMENT_PATH = """source || '/' || lang || '/' || CAST(doc_id DIV 256 AS STRING) || '/' ||
 CASE WHEN regexp_like(split_part(text, '\\n', 1), '(?i)licen[cs]e|copyright')
      THEN CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id DIV 16 AS STRING) || '/' ELSE '' END
           || 'LICENSE-' || CAST(doc_id AS STRING)
      ELSE CAST(doc_id DIV 16 AS STRING) || '/' || CAST(doc_id AS STRING) || '.txt' END"""


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("text", F.expr(DOCUMENT_PATH).alias("path"))
    return licenses.scan(files).select(
        F.regexp_extract("path", r"(\d+)(?:\.txt)?$", 1).cast("long").alias("doc_id"),
        "path", "licence", "how", "cosine", "licence_dir")


def _license_sql() -> str:
    rows = ",".join(f"('{a}','{b}',{n},{tf})" for a, b, n, tf in licenses.template_terms())
    path = DOCUMENT_PATH.replace("DIV", "//").replace("STRING", "VARCHAR") \
        .replace("regexp_like", "regexp_matches").replace("'\\n'", "chr(10)")
    return f"""
WITH t(licence, term, template, tf) AS (VALUES {rows}),
files AS (SELECT text, {path} AS path FROM documents),
folders AS (SELECT path, text, regexp_replace(path, '/[^/]*$', '') AS folder FROM files),
lines AS (SELECT path, unnest(string_split(text, chr(10))) AS words,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
terms AS (SELECT path, line, term, COUNT(*) AS tf FROM (
            SELECT path, line, unnest(regexp_extract_all(lower(words), '{licenses.TERM}')) AS term
            FROM lines WHERE regexp_matches(words, '{licenses.MARKER}')) GROUP BY ALL),
n AS (SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT path, line FROM terms))
           + (SELECT COUNT(DISTINCT template) FROM t) AS total),
df AS (SELECT term, SUM(c) AS df FROM (
         SELECT term, COUNT(*) AS c FROM t GROUP BY term UNION ALL
         SELECT term, COUNT(*) FROM terms WHERE term IN (SELECT term FROM t) GROUP BY term)
       GROUP BY term),
idf AS (SELECT term, ln((1 + total) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM df, n),
w AS (SELECT licence, term, template, tf * idf / sqrt(SUM(tf * idf * tf * idf)
        OVER (PARTITION BY template)) AS weight FROM t JOIN idf USING (term)),
v AS (SELECT path, line, term, tf * COALESCE(idf, ln(1 + total) + 1) AS value
      FROM terms CROSS JOIN n LEFT JOIN idf USING (term)),
z AS (SELECT path, line, sqrt(SUM(value * value)) AS size FROM v GROUP BY ALL),
scored AS (SELECT path, licence, round(SUM(value * weight) / ANY_VALUE(size), 6) AS cosine
           FROM v JOIN w USING (term) JOIN z USING (path, line)
           GROUP BY path, line, licence, template),
own AS (SELECT path, licence, cosine FROM scored WHERE cosine >= {licenses.Rule().threshold}
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, licence) = 1),
dirs AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, licence FROM own
         WHERE regexp_matches(regexp_replace(path, '^.*/', ''), '{licenses.LICENCE_FILE}')
         QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) = 1),
near AS (SELECT folder, dir, licence FROM (SELECT DISTINCT folder FROM folders)
         JOIN dirs ON folder = dir OR starts_with(folder, dir || '/')
         QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(dir) DESC) = 1)
SELECT CAST(regexp_extract(f.path, '(\\d+)(?:\\.txt)?$', 1) AS BIGINT) AS doc_id, f.path,
       COALESCE(own.licence, near.licence) AS licence,
       CASE WHEN own.licence IS NOT NULL THEN 'notice' WHEN near.licence IS NOT NULL
            THEN 'inherited' ELSE 'none' END AS how, own.cosine,
       CASE WHEN own.licence IS NULL THEN near.dir END AS licence_dir
FROM folders f LEFT JOIN own USING (path) LEFT JOIN near USING (folder)
"""


ORACLES["op1_license_scan"] = _license_sql()


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = pseudo_lm.word_counts(docs)
    model = pseudo_lm.train(docs, counts=counts)
    words = pseudo_lm.lexicon(counts, model)
    common.drop_staged(counts)
    return pseudo_lm.score(docs, model, within=words).withColumns({
        c: F.round(c, 4) for c in ("log_likelihood", "mean_log_prob")})


@query
def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.round_trip(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_statistics(table(spark, sf_dir, "documents"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_conversation_trie"] = """
WITH t AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id
                                ORDER BY turn NULLS FIRST, role, text) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns
        FROM t GROUP BY conv_id),
c AS (SELECT conv_id, turns, xor(list_reduce(
        [CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                                       lambda s: CAST(ascii(s) AS BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i:
          xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
      FROM own),
r AS (SELECT c.conv_id, COALESCE(o.turns[1:h], []) || c.turns[h + 1:] AS turns
      FROM c LEFT JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d, turns[1:d] AS node, len(turns) AS size
      FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT node, d, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs,
             string_agg(CASE WHEN size = d THEN CAST(conv_id AS VARCHAR) END, ','
                        ORDER BY conv_id) AS ends FROM p GROUP BY node, d),
k AS (SELECT n.*, u.conv_id AS parent_conv_id, COALESCE(j.n_children, 0) AS n_children,
             (n.n_convs - 1) * CASE WHEN n.d = 0 THEN 0 ELSE len(regexp_extract_all(
               n.node[n.d].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
      FROM n LEFT JOIN n u ON n.d > 0 AND u.d = n.d - 1 AND u.node = n.node[1:n.d - 1]
      LEFT JOIN (SELECT node[1:d - 1] AS node, COUNT(*) AS n_children FROM n WHERE d > 0
                 GROUP BY ALL) j ON j.node = n.node),
s AS (SELECT node[1:up] AS node, COUNT(*) FILTER (n_children = 0) AS n_leaves,
             SUM(saved) AS saved_tokens
      FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM k) GROUP BY ALL)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(COALESCE(ends, '')) AS ends_sha256
FROM k JOIN s USING (node)
"""
