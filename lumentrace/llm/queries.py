"""The queries of these operators over the whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.llm import bpe, chat_format, embedding_dedup, exact_dedup, merkle_manifest, minhash_dedup, multiset_hash, packing, prefix_trie, quality, substring_dedup, suffix_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, which is installed at the same place on all executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), length=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encoded(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    n = F.expr("length(ids) div 4").alias("n_tokens")
    return out.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.grouped(table(spark, sf_dir, "documents"), k=3, percent=85)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.turn_rows(table(spark, sf_dir, "conversations")).unionByName(chat_format.planted(spark))
    back = chat_format.read_back(chat_format.formatted(rows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.grouped(table(spark, sf_dir, "embeddings"), least=0.95)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = multiset_hash.fingerprinted(table(spark, sf_dir, "documents"))
    prints = [multiset_hash.printed(F.col(c)).alias(n) for c, n in (("vector", "fingerprint"), ("edited_vector", "edited_fingerprint"))]
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *prints, "near_edited", "near_next")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.proved(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_suffix_dedup, op3_bpe, op4_minhash_dedup, op5_substring_dedup, op6_chat_format, op7_toxicity, op8_exact_dedup, op9_embedding_dedup,
        op10_quality, op11_multiset_hash, op12_prefix_trie, op13_merkle_manifest,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op6_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        e AS (SELECT *, length('<|im_start|>' || role || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10)) AS size FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding, embedding) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id),
        c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM d""",
    "op11_multiset_hash": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
        e AS (SELECT doc_id, n_chars, text, substr(text, 1, n_chars - n_chars // 3) || substr(coalesce(lead(text) OVER w, first(text) OVER w), 1, n_chars // 3) AS edited,
                     coalesce(lead(doc_id) OVER w, first(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id DESC)),
        t AS (SELECT doc_id, 0 AS k, text AS t FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
        p AS (SELECT doc_id, k, sha256(unnest(regexp_extract_all(t, '[^\n.!?;:|]{1,48}[^\n.!?;:| \t\n\x0B\f\r]{0,48}[\n.!?;:|]*[ \t\n\x0B\f\r]*|[\n.!?;:|]+[ \t\n\x0B\f\r]*'))) AS h FROM t),
        n AS (SELECT doc_id, k, count(*) % 16384 AS n FROM p GROUP BY ALL),
        b AS (SELECT doc_id, k, w.w, s.s, sum((x >> s.s) & 1)::BIGINT % 16384 AS c
              FROM (SELECT doc_id, k, w, ('0x' || substr(h, (1 + 15 * w)::BIGINT, 15))::BIGINT AS x FROM p, range(4) AS r(w)) AS w, range(60) AS s(s) GROUP BY ALL),
        c AS (SELECT t.doc_id, t.k, w.w, s.s, coalesce(c, 0) AS c, coalesce(n, 0) AS n FROM t CROSS JOIN range(4) AS w(w) CROSS JOIN range(60) AS s(s)
              LEFT JOIN b ON b.doc_id = t.doc_id AND b.k = t.k AND b.w = w.w AND b.s = s.s LEFT JOIN n ON n.doc_id = t.doc_id AND n.k = t.k),
        f AS (SELECT doc_id, k, list((2 * c - n + 8192 + 32768) % 16384 - 8192 ORDER BY w, s) AS v, any_value(n) AS n FROM c GROUP BY ALL),
        words AS (SELECT doc_id, k, w, s % 15 AS shift, sum(c << (15 * (s // 15)))::BIGINT AS x FROM c GROUP BY ALL),
        f2 AS (SELECT doc_id, k, string_agg(printf('%015x', x), '' ORDER BY w, shift) AS print FROM words GROUP BY ALL),
        g AS (SELECT f.doc_id, f.k, v, printf('%015x', n) || print AS print, list_sum(list_transform(v, lambda x: x * x))::BIGINT AS size FROM f JOIN f2 ON f.doc_id = f2.doc_id AND f.k = f2.k),
        near AS (SELECT e.doc_id, o.k AS other, CASE WHEN a.print = o.print THEN 1.0::DOUBLE WHEN a.size = 0 OR o.size = 0 THEN 0.0 ELSE least(1.0, greatest(0.0,
                     list_sum(list_transform(list_zip(a.v, o.v), lambda z: z[1] * z[2]))::DOUBLE / sqrt((a.size * o.size)::DOUBLE))) END AS near
                 FROM e JOIN g a ON a.doc_id = e.doc_id AND a.k = 0 JOIN g o ON (o.doc_id = e.doc_id AND o.k = 1) OR (o.doc_id = e.next_id AND o.k = 0))
        SELECT e.doc_id, n_chars, sha256(edited) AS edited_sha256, a.print AS fingerprint, o.print AS edited_fingerprint, x.near AS near_edited, y.near AS near_next
        FROM e JOIN g a ON a.doc_id = e.doc_id AND a.k = 0 JOIN g o ON o.doc_id = e.doc_id AND o.k = 1
        JOIN near x ON x.doc_id = e.doc_id AND x.other = 1 JOIN near y ON y.doc_id = e.doc_id AND y.other = 0""",
    "op12_prefix_trie": r"""
        WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL),
        bits AS (SELECT i, i AS x, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM bits WHERE k < 8),
        crc AS (SELECT conv_id, conv_id::VARCHAR AS s, 4294967295 AS x, 0 AS k FROM (SELECT DISTINCT conv_id FROM t)
                UNION ALL SELECT conv_id, s, xor(crc.x >> 8, bits.x), crc.k + 1 FROM crc JOIN bits ON bits.k = 8 AND bits.i = xor(crc.x & 255, ascii(substr(s, crc.k + 1, 1))) WHERE crc.k < length(s)),
        c AS (SELECT conv_id, xor(x, 4294967295) % 4 AS h FROM crc WHERE k = length(s)),
        r AS (SELECT c.conv_id, t.place, 0 AS own, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.place <= h
              UNION ALL SELECT c.conv_id, t.place, 1, role, text FROM c JOIN t USING (conv_id) WHERE t.place > h),
        p AS (SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^ 	-
]+')) AS words,
                     sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER w) AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)
              UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
        q AS (SELECT *, lag(key) OVER w AS parent, lead(key) OVER w IS NULL AS last FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
        n AS (SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM q GROUP BY key),
        k AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
        s AS (SELECT q.key, count(*) FILTER (k.key IS NULL) AS n_leaves, sum(n.own)::BIGINT AS saved_tokens
              FROM n JOIN q ON q.conv_id = n.conv_id AND q.depth <= n.depth LEFT JOIN k ON k.key = n.key GROUP BY q.key)
        SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM n JOIN s USING (key) LEFT JOIN k USING (key) LEFT JOIN n m ON m.key = n.parent""",
    "op13_merkle_manifest": r"""
        WITH RECURSIVE f AS (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                       || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
        d AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                     sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS changed FROM f),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS total FROM d),
        low AS (SELECT tree, 0 AS level, place, total, leaf AS hash FROM leaves
                UNION ALL SELECT tree, level + 1, place // 8, any_value((total + 7) // 8), sha256(string_agg(hash, '' ORDER BY place)) FROM low WHERE total > 1 GROUP BY tree, level, place // 8),
        heads AS (SELECT tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS total, hash FROM low WHERE total = 1),
        high AS (SELECT 0 AS level, place, total, hash FROM heads
                 UNION ALL SELECT level + 1, place // 8, any_value((total + 7) // 8), sha256(string_agg(hash, '' ORDER BY place)) FROM high WHERE total > 1 GROUP BY level, place // 8),
        sides AS (SELECT tree, level, place, coalesce(string_agg(hash, '' ORDER BY place) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                         coalesce(string_agg(hash, '' ORDER BY place) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                  FROM (SELECT tree, level, place, total, hash FROM low UNION ALL SELECT '', level, place, total, hash FROM high) WHERE total > 1
                  WINDOW w AS (PARTITION BY tree, level, place // 8 ORDER BY place)),
        crc_bits AS (SELECT i, i AS x, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
        crc AS (SELECT doc_id, doc_id::VARCHAR AS s, 4294967295 AS x, 0 AS k FROM (SELECT DISTINCT doc_id FROM d WHERE doc_id IS NOT NULL)
                UNION ALL SELECT doc_id, s, xor(crc.x >> 8, b.x), crc.k + 1 FROM crc JOIN crc_bits b ON b.k = 8 AND b.i = xor(crc.x & 255, ascii(substr(s, crc.k + 1, 1))) WHERE crc.k < length(s)),
        hit AS (SELECT doc_id FROM crc WHERE k = length(s) AND xor(x, 4294967295) % 3 = 0),
        a AS (SELECT tree AS from_tree, place AS from_place, tree, 0 AS level, place, '' AS proof, CASE WHEN hit.doc_id IS NULL THEN leaf ELSE changed END AS hash FROM leaves LEFT JOIN hit USING (doc_id)
              UNION ALL SELECT a.from_tree, a.from_place, a.tree, a.level + 1, a.place // 8, a.proof || s.l || s.r, sha256(s.l || a.hash || s.r) FROM a JOIN sides s ON s.tree = a.tree AND s.level = a.level AND s.place = a.place),
        b AS (SELECT from_tree, from_place, 0 AS level, h.place, proof, a.hash FROM a JOIN heads h ON h.tree = a.from_tree JOIN low ON low.tree = a.tree AND low.level = a.level AND low.total = 1
              UNION ALL SELECT from_tree, from_place, b.level + 1, b.place // 8, b.proof || s.l || s.r, sha256(s.l || b.hash || s.r) FROM b JOIN sides s ON s.tree = '' AND s.level = b.level AND s.place = b.place)
        SELECT leaves.doc_id, leaf, heads.hash AS subroot, root.hash AS root, sha256(b.proof) AS proof_sha256, b.hash AS folded_root, b.hash = root.hash AS verified
        FROM leaves JOIN heads ON heads.tree = leaves.tree JOIN high root ON root.total = 1 JOIN b ON b.from_tree = leaves.tree AND b.from_place = leaves.place AND b.level = root.level""",
}
