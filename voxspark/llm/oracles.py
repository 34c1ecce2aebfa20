"""SQL that must return the rows of a registered query, for DuckDB over the same tables."""

from __future__ import annotations


def _clusters(rounds: int = 3, clusters: int = 16, components: int = 64) -> str:
    """Rounds of k-means spelled out: every round joins all vectors to all centroids and floors the means."""
    parts = [
        f"""kept AS (
  SELECT vec_id, row_number() OVER () AS place,
    list_transform(embedding, lambda x: CAST(floor({components} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {components}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components})""",
        f"""centers0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v FROM kept
  QUALIFY cluster < {clusters})""",
    ]
    for number in range(rounds + 1):
        parts.append(
            f"""near{number} AS (
  SELECT place, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT k.place, k.vec_id, k.v, c.cluster,
          list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM kept AS k, centers{number} AS c) AS pairs GROUP BY place)"""
        )
        if number < rounds:
            parts.append(
                f"""sums{number} AS (
  SELECT cluster, axis, sum(x) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS axis FROM near{number}) AS e GROUP BY cluster, axis),
means{number} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY axis) AS v FROM sums{number} GROUP BY cluster),
centers{number + 1} AS (
  SELECT cluster, coalesce(m.v, c.v) AS v FROM centers{number} AS c LEFT JOIN means{number} AS m USING (cluster))"""
            )
    last = f"near{rounds}"
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM {last} AS n JOIN centers{rounds} AS c USING (cluster)"""
    )


#: CRC-32 needs eight shifts a byte, by its polynomial; features are few enough to take them one by one.
_RESAMPLING = """
WITH bytes AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS b) AS r) AS s),
texts AS (
  SELECT 's' AS side, row_number() OVER () AS place, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, place, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts),
runs AS (
  SELECT side, place, doc_id, len(w) AS n_words,
    list_concat(w, CASE WHEN len(w) < 2 THEN [] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS f
  FROM words),
used AS (SELECT side, place, unnest(f) AS f FROM runs),
crc AS (
  SELECT f, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))),
      lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS BIGINT) AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM used) AS d, bytes),
counted AS (
  SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM used JOIN crc USING (f) GROUP BY bucket),
totals AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM counted),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + CAST(1 AS DOUBLE)) * (s_all + 10000) / ((s + CAST(1 AS DOUBLE)) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM counted, totals),
sums AS (
  SELECT place, count(*) AS n, sum(gain) AS g FROM used JOIN crc USING (f) JOIN gains USING (bucket) WHERE side = 's' GROUP BY place),
scored AS (
  SELECT doc_id, place, n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
    CAST(coalesce((g - ((g % n) + n) % n) // n, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM runs LEFT JOIN sums USING (place) WHERE side = 's'),
noisy AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM scored),
ranked AS (
  SELECT *, n_words >= 20 AS able, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r FROM noisy)
SELECT doc_id, n_features, weight, score,
  CASE WHEN able AND r <= (SELECT 25 * count(*) // 100 FROM noisy WHERE n_words >= 20) THEN r END AS rank
FROM ranked
"""

_PAGES = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
kept AS (SELECT payload, max(page_id) AS page_id FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload)
SELECT p.page_id, payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN k.page_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.page_id <> p.page_id THEN k.page_id END AS refers_to
FROM payloads AS p LEFT JOIN kept AS k USING (payload)
"""

#: Pairs are counted by shingle, so this is for small tables.
_NEAR = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n - count(*) AS whole, count(*) AS shared
  FROM held AS x JOIN held AS y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n),
links AS (
  SELECT a, b FROM met WHERE 100 * shared >= 75 * whole UNION ALL SELECT b, a FROM met WHERE 100 * shared >= 75 * whole),
reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT r.doc_id, l.b FROM reached AS r JOIN links AS l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""

#: The published loop of jump consistent hashing in 128-bit integers, and CRC-32 byte by byte from its polynomial.
_SHARDS = """
WITH RECURSIVE bytes AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS b) AS r) AS s),
keys AS (
  SELECT DISTINCT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) AS HUGEINT) AS k
  FROM documents),
jumps AS (
  SELECT doc_id, k, shards, CAST(-1 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS following
  FROM keys, (SELECT unnest([40, 41]) AS shards) AS c
  UNION ALL
  SELECT doc_id, n, shards, following,
    CAST(floor(CAST(following + 1 AS DOUBLE) * (CAST(2147483648 AS DOUBLE) / CAST(n // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, (k * 2862933555777941757 + 1) % CAST('18446744073709551616' AS HUGEINT) AS n FROM jumps WHERE following < shards) AS j),
dealt AS (
  SELECT doc_id, CAST(any_value(shard) FILTER (shards = 40) AS INTEGER) AS shard, CAST(any_value(shard) FILTER (shards = 41) AS INTEGER) AS grown_shard
  FROM jumps WHERE following >= shards GROUP BY doc_id),
sized AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM documents, bytes)
SELECT s.doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY s.doc_id) - 1 AS BIGINT) AS slot, grown_shard
FROM sized AS s JOIN dealt AS d ON s.doc_id IS NOT DISTINCT FROM d.doc_id
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": _NEAR,
    "op9_jump_shards": _SHARDS,
    "op11_shallot_clusters": _clusters(),
    "op12_importance_resampling": _RESAMPLING,
    "op13_warc_round_trip": _PAGES,
}
