"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import alignment, chat, copied, langid, lm_score, mixing, near_dups, packing, periodic, quality, repeats, token_counts, topk
from corpusloom.llm.common import let, split_words, table

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _remainder(divisor: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(_remainder(5) == 1, F.lit(False))
    scored = lm_score.score(table(spark, folder, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op2_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, folder, "documents"), tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_run_length_index(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, folder, "documents"), outputs=("spans", "kept_sha256", "text"))
    return cut.select("doc_id", "repeats.n_bytes", "repeats.n_removed", F.size("repeats.spans").cast("long").alias("n_spans"), "repeats.kept_sha256", "repeats.text")


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.assess(table(spark, folder, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"quality.{n}") for n in names])


def op9_byte_recurrent_langid(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    named = langid.identify(table(spark, folder, "documents"), _remainder(4) != 2)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_chat_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate(table(spark, folder, "conversations"))


def op11_relative_lempel_ziv(spark: SparkSession, folder: str) -> DataFrame:
    cut = copied.remove_copied(table(spark, folder, "documents").select("doc_id", "text"), outputs=("kept_sha256",))
    return cut.select("doc_id", "copied.n_words", "copied.n_removed", "copied.kept_sha256")


def op12_pair_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = alignment.align(table(spark, folder, "documents"), *[tokenizer_path(n) for n in ALIGNED], columns=["doc_id"])
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return aligned.select("doc_id", *[F.col(f"aligned.{n}") for n in names])


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """One document in ten goes on in rounds from some word, by the digest of its id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rounds(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, at(i))), " "))

    planted = let(split_words("text"), rounds)
    return docs.withColumn("text", F.when(h % 10 == 0, planted).otherwise(F.col("text")))


def op13_block_convolution(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_planted_runs(table(spark, folder, "documents").select("doc_id", "text"))
    found = periodic.find_runs(docs, outputs=("runs", "kept_sha256")).select("doc_id", "periodic.*")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("top", longest)
    length, start, period = (F.col("top")[c] for c in ("length", "col2", "col3"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-start).alias("start"), length.alias("length"), (-period).alias("period"),
        F.floor(1000 * length / -period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.col("kept_sha256").alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_context_mixing, op2_circulant_minhash, op3_token_counts, op4_best_fit_packing, op5_exact_top_k, op6_run_length_index, op7_source_mix, op8_quality_rules,
    op9_byte_recurrent_langid, op10_chat_rotation, op11_relative_lempel_ziv, op12_pair_alignment, op13_block_convolution,
)}

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * v.c[i])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.c) = len(v.c)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

_QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), t AS (
  SELECT doc_id, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM t) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
l AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    len(regexp_extract_all(line, '[|»›•→]')) AS marks
  FROM (SELECT doc_id, unnest(lines) AS line FROM d)
), bad AS (
  SELECT doc_id, sum(n) AS n FROM l
  WHERE n > 0 AND (
    (marks >= 3 AND marks * 4 >= n)
    OR (n <= 30 AND regexp_matches(lower(line), 'all rights reserved|licensed under|released under|privacy policy|terms of use|terms of service|cookie|enable javascript|subscribe to|sign up for|log in to|click here|skip to content'))
    OR (len(regexp_extract_all(line, '[#*$%&<>]{{2,}}|!!')) * 2 >= n AND n > 2)
    OR (n >= 40 AND NOT regexp_matches(line, '[.,;:!?…。，！？؟]')))
  GROUP BY doc_id
), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE n > 0 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(bad.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN bad USING (doc_id) LEFT JOIN dup USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * removed_words <= 50 * n_words AS kept FROM b
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || coalesce(md5(text), '~')) AS key
  FROM documents
), s AS (
  SELECT *, [5, 2, 1][CAST((place - 1) % 3 + 1 AS INTEGER)] AS weight FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM d GROUP BY source)
), c AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER before, 0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight
  FROM s WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, (total - used) * weight > 3 * source_size * open_weight AS capped FROM c),
t AS (
  SELECT source, place, source_size, docs, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST(total - coalesce(sum(3 * source_size) FILTER (WHERE capped) OVER (), 0) AS DOUBLE) * CAST(weight AS DOUBLE)
    / CAST(sum(weight) FILTER (WHERE NOT capped) OVER () AS DOUBLE) END AS target,
    CAST(round(CAST(total AS DOUBLE) / 32) AS BIGINT) AS seats
  FROM f
), q AS (
  SELECT place, count(*) AS quota FROM (
    SELECT place, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS r
    FROM (SELECT *, unnest(range(0, CAST(target / 32 + 3 AS BIGINT))) AS k FROM t) WHERE target > 0)
  WHERE r <= seats GROUP BY place
), p AS (
  SELECT d.*, t.place, t.source_size, t.target, coalesce(q.quota, 0) AS quota,
    CAST('0x' || substr(key, 1, 8) AS BIGINT) % CAST(ceil(docs / 1024.0) AS BIGINT) AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON q.place = t.place
), h AS (SELECT place, shard, CAST(sum(size) AS BIGINT) AS words, max(quota) AS quota FROM p GROUP BY place, shard),
hq AS (
  SELECT place, shard, count(*) AS won FROM (
    SELECT place, shard, quota, row_number() OVER (PARTITION BY place ORDER BY words / (2.0 * k + 1) DESC, shard, k) AS r
    FROM (SELECT *, unnest(range(0, quota)) AS k FROM h) WHERE words > 0)
  WHERE r <= quota GROUP BY place, shard
), w AS (
  SELECT h.place, h.shard, CAST(ceil(words / 32.0) AS BIGINT) AS blocks, least(coalesce(won, 0), 3 * CAST(ceil(words / 32.0) AS BIGINT)) AS won,
    CAST('0x' || substr(md5('7|' || h.place || '|' || h.shard), 1, 8) AS BIGINT) AS turn
  FROM h LEFT JOIN hq USING (place, shard)
), e AS (
  SELECT p.*, blocks, won, turn, CAST(sum(size) OVER (PARTITION BY p.place, p.shard ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM p JOIN w ON w.place = p.place AND w.shard = p.shard
), b AS (
  SELECT *, unnest(range((stop - size) // 32, (stop - 1) // 32 + 1)) AS block FROM e WHERE size > 0
), o AS (
  SELECT key, place, stop, sum(CASE WHEN (block * CASE WHEN blocks % 1000003 = 0 THEN 1 ELSE 1000003 END + turn) % blocks < won % blocks
    THEN least(stop, (block + 1) * 32) - greatest(stop - size, block * 32) ELSE 0 END) AS part
  FROM b GROUP BY key, place, stop
)
SELECT e.doc_id, e.size, e.source_size, e.target,
  CAST(CASE WHEN e.size > 0 THEN (won // blocks) * e.size + o.part ELSE 0 END AS BIGINT) AS taken
FROM e LEFT JOIN o ON o.key = e.key AND o.place = e.place AND o.stop = e.stop AND e.size > 0
"""

_CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS s, coalesce(text, '') AS x FROM conversations),
p AS (SELECT DISTINCT conv_id, s AS perspective FROM t WHERE s <> 'system'),
r AS (
  SELECT t.*, perspective, s = perspective AS own, '<|im_start|>' || CASE WHEN s = perspective THEN 'assistant' WHEN s = 'system' THEN 'system'
    ELSE 'user name=' || regexp_replace(s, '\s', '_', 'g') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), m AS (SELECT *, head || x || '<|im_end|>' || chr(10) AS line FROM r),
o AS (
  SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, s, x
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM m
), g AS (SELECT *, CAST(pos AS BIGINT) // 16384 AS part FROM o),
f AS (SELECT *, min(pos) OVER (PARTITION BY conv_id, perspective, part) AS begin FROM g)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(line, '' ORDER BY pos) AS text,
  coalesce(list(CAST(pos + length(head) - begin AS BIGINT) ORDER BY pos) FILTER (WHERE own), []) AS mask_from,
  coalesce(list(CAST(pos + length(line) - 1 - begin AS BIGINT) ORDER BY pos) FILTER (WHERE own), []) AS mask_to
FROM f GROUP BY conv_id, perspective, part
"""

_NEAR = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

_COPIED = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE doc_id > first),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_PERIODIC = r"""
WITH c AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS h
  FROM documents
), e AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS planted FROM c),
o AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
d AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM o
), x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q, row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS r
  FROM x JOIN x AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM same GROUP BY doc_id, q, i - r),
run AS (SELECT doc_id, s, l, min(q) AS q FROM stretch WHERE l >= greatest(6, 4 * q) GROUP BY doc_id, s, l),
shown AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    first([s, l, q] ORDER BY l DESC, s, q) AS top FROM run GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top[1] AS BIGINT) AS start, CAST(top[2] AS BIGINT) AS length, CAST(top[3] AS BIGINT) AS period,
  CAST(1000 * top[2] // top[3] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN shown USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {
    "op2_circulant_minhash": _NEAR,
    "op5_exact_top_k": _TOP_K,
    "op7_source_mix": _MIX,
    "op8_quality_rules": _QUALITY,
    "op10_chat_rotation": _CHAT,
    "op11_relative_lempel_ziv": _COPIED,
    "op13_block_convolution": _PERIODIC,
}
