"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import uuid

from tidewater.llm import bpe, dedup, frames, merkle, mixing, negatives, ogg, pii, quality, sharding, simhash, tokencount, urlfilter
from tidewater.llm.common import shared_dir, table


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_url_filter(spark, sf_dir):
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark, sf_dir):
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_media_ogg(spark, sf_dir):
    return ogg.media_documents(table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op9_personal_data(spark, sf_dir):
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_files(spark, sf_dir):
    return frames.token_files(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}")


def op12_hard_negatives(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_token_counts, op3_sharding, op4_url_filter, op5_exact_dedup,
    op6_media_ogg, op7_bpe_round_trip, op8_source_mix, op9_personal_data, op10_quality,
    op11_token_files, op12_hard_negatives, op13_merkle_manifest,
)}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": r"""
        WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
        r(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        n AS (SELECT row_number() OVER () AS row, * FROM q),
        j AS (SELECT n.*, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC) AS k
              FROM n LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM j WHERE k = 1""",
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
              FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
    "op8_source_mix": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
              CAST('0x' || substr(md5(concat_ws(':', 'mix', doc_id, md5(coalesce(text, '')))), 1, 7) AS BIGINT) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight, 2 * source_size AS lim FROM s),
        l AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - CAST(coalesce(sum(lim) OVER b, 0) AS BIGINT)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
              FROM w WINDOW b AS (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT coalesce('s' || source, '') AS key, source_size, least(CAST(lim AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
        m AS (SELECT doc_id, size, coalesce('s' || source, '') AS key, length(bin(size)) * 16 + CAST(floor(size * 16 / pow(2.0::DOUBLE, length(bin(size)))) AS INTEGER) AS band,
              h FROM d),
        r AS (SELECT m.*, t.source_size, t.target, row_number() OVER (PARTITION BY m.key ORDER BY band, h % (1 + CAST(floor(sqrt((SELECT count(*) FROM d))) AS BIGINT) // 32), size, h, doc_id) AS rn,
              CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, CAST('0x' || substr(md5('mix:offset:' || m.key), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS o
              FROM m JOIN t ON m.key = t.key)
        SELECT doc_id, size, source_size, target, CAST(least(2, floor(rn * rate + o) - floor((rn - 1) * rate + o)) AS BIGINT) * size AS taken FROM r""",
    "op12_hard_negatives": r"""
        WITH e AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
              list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
              FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[]) AS BIGINT) AS score
              FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.row <> b.row),
        p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS FIRST) AS place FROM s WHERE same QUALIFY place <= 5),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id NULLS FIRST) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
              FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
        SELECT * FROM n WHERE rank <= 5""",
    "op13_merkle_manifest": r"""
        WITH RECURSIVE f AS (SELECT row_number() OVER () AS row, doc_id, lang, n_chars, list_transform([doc_id::VARCHAR, source, lang, text], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS s,
              coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more FROM documents),
        c AS (SELECT *, list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
              lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END) AS crc FROM f),
        l AS (SELECT row, doc_id, lang, sha256(s[1] || s[2] || s[3] || n || s[4]) AS leaf,
              sha256(s[1] || s[2] || s[3] || CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN more ELSE n END || s[4]) AS claimed FROM c),
        p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
        a AS (SELECT tree, 0 AS level, pos AS i, n, leaf AS h FROM p
              UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY tree, level, i // 2, n),
        r AS (SELECT tree, h AS subroot, max(level) OVER () AS deepest, level AS depth, count(*) OVER () AS trees FROM a WHERE n = 1),
        b AS (SELECT 0 AS level, tree AS i, trees AS n, subroot AS h FROM r
              UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY level, i // 2, n),
        w AS (SELECT p.row, a.level, a.h AS sibling, a.i < p.pos >> a.level AS before FROM p JOIN a ON p.tree = a.tree AND a.i = xor(p.pos >> a.level, 1) AND a.n > 1
              UNION ALL SELECT p.row, 100 + b.level, b.h, b.i < p.tree >> b.level FROM p JOIN b ON b.i = xor(p.tree >> b.level, 1) AND b.n > 1
              UNION ALL SELECT p.row, x.level, '', false FROM p JOIN (SELECT DISTINCT tree, level, i, n FROM a WHERE n > 1) x ON p.tree = x.tree AND x.i = p.pos >> x.level AND xor(x.i, 1) >= x.n
              UNION ALL SELECT p.row, 100 + x.level, '', false FROM p JOIN (SELECT DISTINCT level, i, n FROM b WHERE n > 1) x ON x.i = p.tree >> x.level AND xor(x.i, 1) >= x.n),
        q AS (SELECT row, list(sibling ORDER BY level) AS siblings, list(before ORDER BY level) AS befores FROM w GROUP BY row),
        o AS (SELECT row, 1 AS k, claimed AS h, coalesce(siblings, []) AS siblings, befores FROM p LEFT JOIN q USING (row)
              UNION ALL SELECT row, k + 1, CASE WHEN befores[k] THEN sha256(siblings[k] || h) ELSE sha256(h || siblings[k]) END, siblings, befores FROM o WHERE k <= len(siblings))
        SELECT p.doc_id, leaf, subroot, b.h AS root, sha256(array_to_string(o.siblings, '')) AS proof_sha256, o.h AS folded_root, o.h = b.h AS verified
        FROM p JOIN o ON p.row = o.row AND o.k = len(o.siblings) + 1 JOIN r ON p.tree = r.tree JOIN b ON b.n = 1""",
}
