"""The numbered queries over the corpus tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuegrid.llm import blockmax, dart, forest, language, lineblocks, lines, merkle, packing, recompress, secrets, shards, transducer, whitening


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_block_max_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return blockmax.top_k(rows, rows.where("vec_id % 100 = 0"))


#: All scores of all queries, ranked.
OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op2_crf_language(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    seen = language.predict(docs.select("doc_id", "text"), language.train(docs), shares=False)
    return seen.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import path

    return packing.pack(table(spark, folder, "documents"), path("word_bpe_49k.json"))


def op4_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return forest.nearest(rows, rows.where("vec_id % 100 = 0"))


def op5_recompression_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return recompress.dedup(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, folder, "documents")))


def op7_line_block_text(spark: SparkSession, folder: str) -> DataFrame:
    return lineblocks.extract(table(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op8_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    return shards.byte_shards(table(spark, folder, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: make for name, make in globals().items() if name.startswith("op") and name[2].isdigit()}


def op9_piece_transducer(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import path

    return transducer.digest(table(spark, folder, "documents"), path("piece_bpe_32k.model"))


def op10_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return dart.near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id")


def op11_jacobi_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_line_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    return lines.kept_texts(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_midstate_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    return merkle.manifest(table(spark, folder, "documents"), merkle.tampered(F.col("doc_id"), F.col("text")))


#: Checksums by folding over bytes, running sizes in order of doc_id, and where each middle byte lies.
OP8 = """
WITH one AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc FROM d, one),
p AS (SELECT *, sum(size) OVER w - size AS first_byte, sum(size) OVER () AS total FROM c WINDOW w AS (ORDER BY doc_id, crc, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least(15, ((2 * first_byte + size) * 16) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc, size) - 1 AS slot,
  NULL::INTEGER AS grown_shard FROM s
"""

#: Shingle counts, all pairs that share a shingle, and what their links reach.
OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle, count(*) AS n FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0 GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN t AS x ON x.doc_id = a JOIN t AS y ON y.doc_id = b WHERE 5 * common >= 4 * (x.total + y.total - common)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, ways.b FROM r JOIN ways ON ways.a = r.other)
SELECT doc_id, min(other)::BIGINT AS class_id FROM r GROUP BY doc_id
"""

#: Words, all windows as text, and the words a repeated window covers.
OP5 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM w, unnest(range(1, len(ws) - 48)) AS t(i) WHERE len(ws) >= 50),
m AS (SELECT win, min(doc_id) AS source FROM s GROUP BY win),
c AS (SELECT s.doc_id, list(DISTINCT i + k) AS gone FROM s JOIN m ON s.win = m.win AND s.doc_id > m.source, range(50) AS u(k) GROUP BY s.doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS stay FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, n::BIGINT AS n_words, (n - len(stay))::BIGINT AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM k
"""

#: All lines with their keys, and the largest document of each key that repeats.
OP12 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN m ON k.key = m.key GROUP BY k.doc_id
"""

#: All levels of all trees ('=lang' and, above them, '~'), the steps from each leaf to the root, and folds along them.
OP13 = r"""
WITH RECURSIVE parts AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, text, array_to_string([CASE WHEN x IS NULL THEN '-' ELSE octet_length(encode(x)) || ':' || x END
    FOR x IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR]], '') AS head FROM documents),
texts AS (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM parts JOIN
  (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)), 4294967295::UBIGINT) AS crc
   FROM (SELECT doc_id, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda x: ascii(x)::UBIGINT) AS bytes FROM documents)) USING (doc_id)),
leaves AS (SELECT doc_id, tree, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
  sha256(head || CASE WHEN other IS NULL THEN '-' ELSE octet_length(encode(other)) || ':' || other END) AS changed,
  row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx FROM texts),
low(tree, level, idx, node) AS (SELECT tree, 0, idx, leaf FROM leaves UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, level, idx // 8),
depths AS (SELECT tree, max(level) AS depth FROM low GROUP BY tree),
subroots AS (SELECT tree, node AS subroot, depth, row_number() OVER (ORDER BY tree) - 1 AS place FROM low JOIN depths USING (tree) WHERE level = depth),
high(level, idx, node) AS (SELECT 0, place, subroot FROM subroots UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY level, idx // 8),
nodes AS (SELECT * FROM low UNION ALL SELECT '~', level, idx, node FROM high),
top AS (SELECT max(level) AS height, arg_max(node, level) AS root FROM high),
steps AS (SELECT doc_id, l AS step, tree, l AS level, idx >> (3 * l) AS own FROM leaves JOIN depths USING (tree), unnest(range(depth)) AS t(l)
  UNION ALL SELECT doc_id, depth + l, '~', l, place >> (3 * l) FROM leaves JOIN subroots USING (tree), top, unnest(range(height)) AS t(l)),
runs AS (SELECT doc_id, step, own, idx, node FROM steps JOIN nodes ON nodes.tree = steps.tree AND nodes.level = steps.level AND nodes.idx // 8 = own // 8),
proofs AS (SELECT doc_id, sha256(string_agg(node, '' ORDER BY step, idx)) AS proof FROM runs WHERE idx <> own GROUP BY doc_id),
folds(doc_id, step, node) AS (SELECT doc_id, 0, changed FROM leaves UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(string_agg(CASE WHEN idx = own THEN f.node ELSE r.node END, '' ORDER BY idx)) FROM folds AS f JOIN runs AS r ON r.doc_id = f.doc_id AND r.step = f.step GROUP BY f.doc_id, f.step),
ends AS (SELECT doc_id, arg_max(node, step) AS folded FROM folds GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves JOIN subroots USING (tree) JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id), top
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_block_max_search": OP1, "op5_recompression_dedup": OP5, "op8_byte_shards": OP8, "op10_dart_minhash": OP10, "op12_line_bitmaps": OP12, "op13_midstate_manifest": OP13}
