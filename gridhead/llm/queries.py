"""The operators' registered queries and the SQL that some can be checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhead.llm import ann, decontaminate, langid, licenses, merkle, near_dup, pieces, quality, suffix_dedup, token_counts, turns, url_filter, warc
from gridhead.llm.common import table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).drop("spans")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_pieces", "ids", "round_trip")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    labels = (F.array_join(c, ",").alias(c) for c in ("base_labels", "labels"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *labels, "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations are damaged by a hash of each turn's place, then repaired."""
    rows = table(spark, sf_dir, "conversations")
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(place.cast("binary")) % 20
    damaged = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return turns.repair(damaged, absent="gone")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts claimed are the table's own, but that half of the documents lose their line ends."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claimed = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs = merkle.prove(table(spark, sf_dir, "documents"), claimed)
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", verified)


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_nearest_neighbours, op3_language_id, op4_url_filter, op5_suffix_dedup, op6_sentencepiece, op7_token_counts, op8_quality, op9_near_duplicates, op10_decontaminate, op11_license_scan, op12_conversation_repair, op13_merkle_manifest)}


def _crc32(text: str) -> str:
    """SQL of the CRC-32 of an ASCII text, bit by bit."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii({text}[i]) AS BIGINT))"
    byte = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b))"
    return f"xor(list_reduce({codes}, lambda a, b: {byte}, 4294967295::BIGINT), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _option(allowed: str, more: str, letter: str, turn: str, then: str) -> str:
    """SQL of one edit: cost, letters and turns (each behind a line end) of all that follows, or null."""
    return f"CASE WHEN {allowed} THEN {{'c': {then}.c + {more}, 'a': '{letter}' || {then}.a, 't': {turn} || {then}.t}} END"


def _edits(state: str, kept: str, following: str) -> str:
    """SQL of the best edit of a turn in a state; `kept` are the initials that may stay and the states behind them."""
    late, after = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END", {"u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}[following]
    options = [_option("true", "2", "D", "''", f"b{state}"), _option("stays", f"1 + {late}", "R", f"chr(10) || '{name}:' || text", f"b{following}")]
    options += [_option(f"stays AND initial = '{k}'", late, "K", "chr(10) || role || ':' || text", f"b{k}") for k in kept]
    return f"list_min([{', '.join(options)}])"


def _added(first: str, initial: str, then: str) -> str:
    name = {"u": "user", "a": "assistant"}[initial]
    return f"list_min([{first}, {_option('true', '5', 'I', f"chr(10) || '{name}:'", then)}])"


ORACLES = {
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM h)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
        FROM m""",
    "op4_url_filter": r"""
        WITH r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        p AS (SELECT page_id,
                     translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
              FROM pages),
        f AS (SELECT p.page_id, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
              FROM p JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY p.page_id)
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)""",
    "op5_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d),
        b AS (SELECT doc_id, n_bytes, base, substr(h, 2 * base + 1, 1398) AS part FROM (SELECT *, unnest(range(0, n_bytes - 199, 500)) AS base FROM n WHERE n_bytes >= 200)),
        k AS (SELECT doc_id, base + i AS pos, md5(substr(part, 2 * i + 1, 400)) AS m FROM (SELECT *, unnest(range(0, least(500, n_bytes - 199 - base))) AS i FROM b)),
        s AS (SELECT doc_id, pos FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
        g AS (SELECT doc_id, pos, sum(CASE WHEN pos - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1000) AS before FROM s)),
        x AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 200 AS b FROM g GROUP BY ALL),
        y AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS done FROM x),
        q AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS front FROM y JOIN n USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(front || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM n LEFT JOIN q USING (doc_id)""",
    "op9_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN\pM_]+') AS ws FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
        c AS (SELECT doc_id, g, count(*) AS k FROM s GROUP BY ALL),
        t AS (SELECT doc_id, sum(k) AS n FROM c GROUP BY ALL),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, sum(least(a.k, b.k)) AS shared FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT u, v FROM p JOIN t x ON x.doc_id = u JOIN t y ON y.doc_id = v WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
        e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
        r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON r.node = e.u)
        SELECT node AS doc_id, min(root) AS class_id FROM r GROUP BY node""",
    "op12_conversation_repair": rf"""
        WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
        k AS (SELECT *, {_crc32("place")} % 20 AS kind FROM c),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, range(2) t(i) WHERE kind <> 0 AND (i = 0 OR kind = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
        s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM s),
        g AS (SELECT *, fault IS NULL OR fault = 'truncated' AS stays FROM f),
        v(conv_id, i, b0, bs, bu, ba) AS (
            SELECT DISTINCT conv_id, n + 1, {{'c': 0, 'a': '', 't': ''}}, {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': 5, 'a': 'I', 't': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 't': ''}} FROM g
            UNION ALL
            SELECT conv_id, i, {_added("e0", "u", "eu")}, {_added("es", "u", "eu")}, eu, ea
            FROM (SELECT conv_id, i, e0, es, {_added("eu", "a", "ea")} AS eu, {_added("ea", "u", "eu")} AS ea
                  FROM (SELECT g.conv_id, g.i, {_edits("0", "su", "u")} AS e0, {_edits("s", "u", "u")} AS es, {_edits("u", "a", "a")} AS eu, {_edits("a", "u", "u")} AS ea
                        FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i - 1))),
        m AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
        r AS (SELECT conv_id, CAST(b0.c AS BIGINT) AS cost, b0.a AS audit, sha256(substr(b0.t, 2)) AS repaired_sha256 FROM v WHERE i = 1)
        SELECT q.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM q.conv_id""",
    "op13_merkle_manifest": rf"""
        WITH RECURSIVE x AS (SELECT *, row_number() OVER () AS r, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS claimed FROM documents),
        d AS (SELECT r, doc_id, source, sha256(head || {_field("text")}) AS leaf, sha256(head || {_field("claimed")}) AS claim FROM (SELECT *, {" || ".join(f"({_field(c)})" for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM x)),
        o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM d),
        n(source, level, k, size, h) AS (SELECT source, 0, place, size, leaf FROM o UNION ALL SELECT source, max(level) + 1, k // 3, (max(size) + 2) // 3, sha256(string_agg(h, '' ORDER BY k)) FROM n WHERE size > 1 GROUP BY source, k // 3),
        s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM n WHERE size = 1),
        t(level, k, size, h) AS (SELECT 0, place, size, subroot FROM s UNION ALL SELECT max(level) + 1, k // 3, (max(size) + 2) // 3, sha256(string_agg(h, '' ORDER BY k)) FROM t WHERE size > 1 GROUP BY k // 3),
        p AS (SELECT r, level AS step, k, h, place // CAST(pow(3, level) AS BIGINT) AS own FROM o JOIN n ON n.source IS NOT DISTINCT FROM o.source AND n.size > 1 AND k // 3 = place // CAST(pow(3, level + 1) AS BIGINT)
              UNION ALL SELECT r, 1000 + level, k, h, s.place // CAST(pow(3, level) AS BIGINT) FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source JOIN t ON t.size > 1 AND k // 3 = s.place // CAST(pow(3, level + 1) AS BIGINT)),
        w AS (SELECT r, dense_rank() OVER (PARTITION BY r ORDER BY step) AS i, front, back FROM (SELECT r, step, coalesce(string_agg(h, '' ORDER BY k) FILTER (k < own), '') AS front, coalesce(string_agg(h, '' ORDER BY k) FILTER (k > own), '') AS back FROM p GROUP BY r, step)),
        f(r, i, v) AS (SELECT r, 0, claim FROM d UNION ALL SELECT f.r, f.i + 1, sha256(front || v || back) FROM f JOIN w ON w.r = f.r AND w.i = f.i + 1),
        z AS (SELECT r, arg_max(v, i) AS folded_root FROM f GROUP BY r),
        y AS (SELECT r, sha256(coalesce(string_agg(front || back, '' ORDER BY i), '')) AS proof_sha256 FROM d LEFT JOIN w USING (r) GROUP BY r)
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
        FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source JOIN z USING (r) JOIN y USING (r), (SELECT h AS root FROM t WHERE size = 1)""",
}
