"""The registered queries of the operators, with production parameters over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import xor

from pyspark.sql import DataFrame, SparkSession

from . import bit_planes, brown_lm, exact_index, mixing, ngram_join, packing, pii, quality_qda, rules, sharding, substring_index, token_counts, vector_codes
from .common import documents


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_texts(documents(spark, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op4_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_pii_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op6_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), bpe_path())


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_report(documents(spark, sf_dir))


def op8_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), bpe_path())


def op9_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.dedup_substrings(documents(spark, sf_dir))


def op10_exact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_index.exact_dedup(documents(spark, sf_dir))


def op11_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_planes.cluster_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(documents(spark, sf_dir))


def op13_limb_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_brown_lm, op2_ngram_jaccard, op3_source_mix, op4_quality_qda, op5_pii_trees, op6_hilbert_pack, op7_rule_cascade, op8_prefix_tokens, op9_substring_index, op10_exact_index,
        op11_bit_planes, op12_feistel_shards, op13_limb_codes,
    )
}

EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM t JOIN g USING (body)
"""

MIX_SQL = rf"""
WITH RECURSIVE slim AS (
  SELECT doc_id, coalesce(source, '(none)') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS tokens
  FROM documents
), sizes AS MATERIALIZED (
  SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_docs FROM slim GROUP BY source
), whole AS MATERIALIZED (
  SELECT CAST(sum(tokens) AS BIGINT) AS total, CAST(count(*) AS DOUBLE) AS n FROM sizes
), unmixed AS (
  SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) >= {mixing.TARGET_ENTROPY} * ln(any_value(n)) OR 1.0 / sum(p) >= {mixing.MAX_REPEATS} AS enough
  FROM (SELECT tokens / CAST(total AS DOUBLE) AS p, n FROM sizes, whole)
), bisect AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT step + 1, CASE WHEN flat THEN mid ELSE low END, CASE WHEN flat THEN high ELSE mid END
  FROM (
    SELECT step, low, high, mid,
           ln(sum(w)) - mid * sum(w * ln(p)) / sum(w) >= {mixing.TARGET_ENTROPY} * ln(any_value(n))
           OR pow(min(p), mid - 1) / sum(w) >= {mixing.MAX_REPEATS} AS flat
    FROM (
      SELECT step, low, high, (low + high) / 2 AS mid, tokens / CAST(total AS DOUBLE) AS p,
             pow(tokens / CAST(total AS DOUBLE), (low + high) / 2) AS w, n
      FROM bisect, sizes, whole WHERE step < {mixing.STEPS}
    ) GROUP BY step, low, high, mid
  )
), exponent AS (
  SELECT CASE WHEN (SELECT enough FROM unmixed) OR (SELECT n FROM whole) < 2 THEN 1.0
              ELSE (SELECT round((low + high) / 2, 6) FROM bisect WHERE step = {mixing.STEPS}) END AS a
), quotas AS (
  SELECT source, tokens, n_docs,
         CAST(floor(pow(tokens / CAST(total AS DOUBLE), a) / (SELECT sum(pow(tokens / CAST(total AS DOUBLE), a)) FROM sizes, whole, exponent)
              * total + 0.5) AS BIGINT) AS quota
  FROM sizes, whole, exponent
), plan AS MATERIALIZED (
  SELECT source, quota // tokens AS epochs, quota % tokens AS rest,
         least({mixing.MAX_BLOCKS}, CAST(ceil(n_docs / {mixing.BLOCK_DOCS}.0) AS BIGINT)) AS n_blocks
  FROM quotas
), part AS MATERIALIZED (
  SELECT doc_id, source, tokens, epochs, rest, n_blocks, k, k % n_blocks AS b
  FROM (SELECT *, CAST('0x' || substr(md5('{mixing.SEED}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS k
        FROM slim JOIN plan USING (source))
), filled AS (
  SELECT source, b, sum(tokens) OVER (PARTITION BY source ORDER BY b, k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used, doc_id, tokens, rest, epochs, n_blocks
  FROM part
), copies AS (
  SELECT doc_id, source, tokens, n_blocks, epochs + CASE WHEN used <= rest THEN 1 ELSE 0 END AS n FROM filled
), dealt AS (
  SELECT doc_id, source, tokens, n_blocks, unnest(range(CAST(n AS BIGINT))) AS epoch FROM copies
)
SELECT doc_id, source, tokens, epoch, order_key % n_blocks AS block, order_key
FROM (SELECT doc_id, source, tokens, n_blocks, CAST(epoch AS INTEGER) AS epoch,
             CAST('0x' || substr(md5('{mixing.SEED}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS order_key
      FROM dealt)
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s
  FROM w
), tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS o
    FROM tokens x JOIN tokens y USING (t) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  WHERE 100 * o >= 80 * (na + nb - o)
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(other) AS component_id FROM reach JOIN sets USING (doc_id) GROUP BY doc_id
"""

SUBSTRING_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS x
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM w)
), firsts AS (SELECT x, min(doc_id) AS f FROM windows GROUP BY x
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (x) WHERE f < doc_id)
  GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(ws) AS n,
    CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END AS k
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

RULES_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)
), again AS (SELECT doc_id, x FROM windows GROUP BY ALL HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN again USING (doc_id, x)) GROUP BY doc_id
), f AS (
  SELECT doc_id, t, len(ws) AS n, len(list_distinct(ws)) AS kinds, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS symbols, coalesce(c.n, 0) AS repeats, octet_length(encode(t)) AS size,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals,
    length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(t, '[^!]', '', 'g')) AS marks, (length(t) - length(replace(t, '://', ''))) // 3 AS links,
    length(t) - length(replace(replace(t, chr(65533), ''), chr(0), '')) AS broken
  FROM w LEFT JOIN covered c USING (doc_id)
), g AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS same, n < 50 OR 100 * repeats > 50 * n AS failed FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(same AS BIGINT) AS n_dup_lines,
  CAST(repeats AS BIGINT) AS n_repeat_words, failed AS base_failed,
  NOT (failed OR 10 * symbols > n OR 2 * marks > n OR letters > size / 5 AND capitals / letters > CAST(0.6 AS DOUBLE) OR 2 * same > n_lines OR 20 * kinds < least(n, 2000)
       OR 2 * digits > size OR 4 * links > n OR 100 * broken > length(t)) AS kept
FROM g
"""

#: floor(sum / count) of whole numbers, also below zero.
FLOOR_MEAN = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT)"


#: Bytes of a text whose checksum is worked out in one piece.
CRC_PIECE = 256


def _crc_step(c: int, bits: int) -> int:
    """So many zero bits through the reflected checksum polynomial."""
    for _ in range(bits):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


def _crc_sql(table: str) -> str:
    """row, crc of a table (row, digits). The checksum is linear: that of a text is the XOR of its pieces' and of its start
    value's, each carried through as many zero bytes as follow; 2**k zero bytes are a matrix of 32 columns."""
    mask, nibbles = (1 << 32) - 1, ", ".join(str(_crc_step(k, 4)) for k in range(16))
    step = lambda c, digit: f"xor({c} >> 4, [{nibbles}][xor({c} & 15, {digit}) + 1])"
    carried = f"""
  SELECT row, len(digits) // 2 AS d, {mask}::BIGINT AS v FROM {table}
  UNION ALL
  SELECT row, after, list_reduce(list_transform(range(1, len(piece), 2), lambda i: CAST('0x' || substr(piece, i, 2) AS BIGINT)),
         lambda c, byte: {step(step("c", "(byte & 15)"), "(byte >> 4)")}, 0::BIGINT)
  FROM (SELECT row, greatest(len(digits) // 2 - skip - {CRC_PIECE}, 0) AS after, substr(digits, 2 * skip + 1, {2 * CRC_PIECE}) AS piece
        FROM (SELECT *, unnest(range(0, len(digits) // 2, {CRC_PIECE})) AS skip FROM {table}))"""
    columns = [_crc_step(1 << b, 8) for b in range(32)]
    for k in range(31):
        terms = [f"(v >> {b} & 1) * {c}" for b, c in enumerate(columns)]
        while len(terms) > 1:
            terms = [f"xor({x}, {y})" for x, y in zip(terms[::2], terms[1::2], strict=True)]
        carried = f"SELECT row, d, CASE WHEN d >> {k} & 1 = 1 THEN {terms[0]} ELSE v END AS v FROM ({carried})"
        twice = lambda x, by=columns: [c for b, c in enumerate(by) if x >> b & 1]
        columns = [reduce(xor, twice(c), 0) for c in columns]
    return f"SELECT row, xor({mask}, bit_xor(v)) AS crc FROM ({carried}) GROUP BY row"


def _clusters_sql() -> str:
    k, rounds, scale, seed = bit_planes.CLUSTERS, bit_planes.ROUNDS, bit_planes.SCALE, bit_planes.SEED
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.row, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM parts v JOIN centres{r} c USING (pos) GROUP BY ALL) GROUP BY row)""")
        if r < rounds:
            steps.append(f"""centres{r + 1} AS MATERIALIZED (
  SELECT c, pos, coalesce(m.x, o.x) AS x FROM centres{r} o LEFT JOIN (
    SELECT c, pos, {FLOOR_MEAN} AS x FROM parts JOIN near{r} USING (row) GROUP BY ALL) m USING (c, pos))""")
    return f"""
WITH ints AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {bit_planes.WIDTH} AND list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), 'bool_and')
), parts AS MATERIALIZED (SELECT row, unnest(range({bit_planes.WIDTH})) AS pos, unnest(v) AS x FROM ints
), centres0 AS MATERIALIZED (
  SELECT c, unnest(range({bit_planes.WIDTH})) AS pos, unnest(v) AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM ints) WHERE c < {k}
), {", ".join(steps)}, sums AS (SELECT c, sum(d) AS d FROM near{rounds} GROUP BY c
), named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM centres{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance, CAST(s.d AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(d) FROM sums) AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} n JOIN ints USING (row) JOIN sums s USING (c) JOIN named USING (c)
"""


def _codes_sql() -> str:
    parts, entries, rounds, scale = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS, vector_codes.SCALE
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT row, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT v.row, part, b.e, sum((v.x - b.x) * (v.x - b.x)) AS d FROM pieces v JOIN book{r} b USING (part, pos) GROUP BY ALL) GROUP BY row, part)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT part, e, pos, coalesce(m.x, o.x) AS x FROM book{r} o LEFT JOIN (
    SELECT part, e, pos, {FLOOR_MEAN} AS x FROM pieces JOIN near{r} USING (row, part) GROUP BY ALL) m USING (part, e, pos))""")
    return f"""
WITH ints AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, len(embedding) // {parts} AS width,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), 'bool_and')
), pieces AS MATERIALIZED (
  SELECT row, i // width AS part, i % width AS pos, x FROM (SELECT row, width, unnest(range(len(v))) AS i, unnest(v) AS x FROM ints)
), book0 AS MATERIALIZED (SELECT part, row AS e, pos, x FROM pieces WHERE row < {entries}
), {", ".join(steps)}, coded AS MATERIALIZED (
  SELECT row, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY part) AS code, sum(d) AS error FROM near{rounds} GROUP BY row
), full_rows AS (SELECT vec_id, label, code, error FROM coded JOIN ints USING (row))
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, pos)) FROM book{rounds}) AS codebooks_sha256
FROM full_rows
"""


def _shards_sql() -> str:
    """The network, with products as HUGEINT."""
    keys = sharding.round_keys(sharding.SEED)
    mask = (1 << 32) - 1
    body = "SELECT row, n, h, p >> h AS l, p & ((1::BIGINT << h) - 1) AS r FROM (SELECT * FROM walk WHERE inside IS NOT TRUE)"
    for key in keys:
        body = f"SELECT row, n, h, l, r, (r + {key}) & {mask} AS a FROM ({body})"
        for m, shift in zip(sharding.MULTIPLIERS, (16, 15), strict=True):
            body = f"SELECT row, n, h, l, r, CAST((CAST(xor(a, a >> {shift}) AS HUGEINT) * {m}) % {1 << 32} AS BIGINT) AS a FROM ({body})"
        body = f"SELECT row, n, h, r AS l, xor(l, xor(a, a >> 13) & ((1::BIGINT << h) - 1)) AS r FROM ({body})"
    return f"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, lower(hex(encode(coalesce(text, '')))) AS digits FROM documents
), sums AS MATERIALIZED (
  SELECT doc_id, len(digits) // 2 + 1 AS size, crc FROM texts JOIN ({_crc_sql("texts")}) USING (row)
), numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY doc_id, size, crc) - 1 AS row, count(*) OVER () AS n FROM sums
), walk AS (
  SELECT row, n, greatest(1, CAST(ceil(length(bin(n - 1)) / 2.0) AS BIGINT)) AS h, row AS p, false AS inside FROM numbered
  UNION ALL
  SELECT row, n, h, (l << h) | r, ((l << h) | r) < n FROM ({body})
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p % {sharding.SHARDS} AS INTEGER) AS shard,
       CAST(p // {sharding.SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, row AS row_number
FROM numbered JOIN (SELECT row, p FROM walk WHERE inside) USING (row)
"""


ORACLE_SQL: dict[str, str] = {
    "op11_bit_planes": _clusters_sql(), "op13_limb_codes": _codes_sql(), "op12_feistel_shards": _shards_sql(),
    "op7_rule_cascade": RULES_SQL, "op2_ngram_jaccard": JACCARD_SQL, "op9_substring_index": SUBSTRING_SQL, "op3_source_mix": MIX_SQL, "op10_exact_index": EXACT_SQL,
}
