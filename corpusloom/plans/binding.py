"""How the stored tables serve as corpus, instructions, logits, rollouts, runs and logs.

Derivations that both engines can read are kept as SQL text and used by each, so the
queries and their oracles start from the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import ordered
from corpusloom.session import checkpoint_root, spread

TABLES = ("documents", "conversations", "embeddings", "events", "labels")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines; adding zero turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def joined_ids(ids: str | Column) -> Column:
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.md5(F.array_join(ids.cast("array<string>"), ","))


# --- corpus ---------------------------------------------------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "source")


def line_key(doc: Column, at: Column) -> Column:
    """Order of a document's line among all lines: at most 2^20 lines per document."""
    return doc * F.lit(1 << 20) + at


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return lines.select("doc_id", line_key(F.col("doc_id"), F.col("at")).alias("line_no"), "raw")


DOCUMENT_LINES = """
lines AS (SELECT doc_id, doc_id * 1048576 + pos - 1 AS line_no, raw FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"""

SPACES = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
WORDS = f"list_filter(regexp_split_to_array(text, '{SPACES}'), lambda w: w <> '')"
WORD_ID = "CAST('0x' || substr(md5(w), 1, 6) AS INTEGER)"
HASHED_IDS = f"list_transform({WORDS}, lambda w: {WORD_ID})"


def md5_ids(expression: str) -> str:
    return f"md5(array_to_string({expression}, ','))"


# --- instruction pairs ----------------------------------------------------------------


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A user turn answered by the next turn; a system turn before it is the input."""
    turns = table(spark, folder, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    reply = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    system = turns.where("role = 'system'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("input"))
    joined = user.join(reply, ["conv_id", "turn"]).join(system, ["conv_id", "turn"], "left")
    return joined.select(
        (F.col("conv_id") * 10000 + F.col("turn")).alias("pair_id"), "conv_id", "instruction",
        F.coalesce("input", F.lit("")).alias("input"), "output",
    )


PAIRS = """
pairs AS (SELECT u.conv_id * 10000 + u.turn AS pair_id, u.conv_id, u.text AS instruction,
       coalesce(s.text, '') AS input, a.text AS output
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn - 1 AND s.role = 'system'
  WHERE u.role = 'user')"""

# Alternate field names with nulls and empty strings in every position.
UPSTREAM = [
    "conv_id * 10000 + turn AS row_id",
    "CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN '' END AS instruction",
    "CASE WHEN conv_id % 4 = 1 THEN concat('p ', text) END AS prompt",
    "CASE WHEN turn % 2 = 0 THEN concat('q ', text) ELSE '' END AS question",
    "CASE conv_id % 5 WHEN 0 THEN role WHEN 1 THEN '' END AS context",
    "CASE WHEN turn % 2 = 1 THEN role END AS input",
    "CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '' END AS response",
    "CASE WHEN conv_id % 2 = 0 THEN '' END AS output",
    "CASE conv_id % 7 WHEN 0 THEN '' WHEN 1 THEN role END AS answer",
]


def pair_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with hashed word ids of instruction and output."""
    from corpusloom.operators.tokens import hashed_word_ids

    return pairs(spark, folder).select(
        "pair_id", "conv_id", hashed_word_ids(F.col("instruction")).alias("prompt_ids"),
        hashed_word_ids(F.col("output")).alias("response_ids"),
    )


def words_of(column: str) -> str:
    return HASHED_IDS.replace("text,", f"{column},", 1)


PAIR_IDS = f"""{PAIRS},
ids AS (SELECT pair_id, conv_id, {words_of('instruction')} AS prompt_ids, {words_of('output')} AS response_ids FROM pairs)"""


# --- evaluation -----------------------------------------------------------------------


BLOCK = 512  # replies of a conversation that meet those of another block in one place


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """A reply is the prediction; all other replies of its conversation are its references."""
    turns = table(spark, folder, "conversations").where("role = 'assistant'")
    return turns.select("conv_id", "turn", (F.col("conv_id") * 10000 + F.col("turn")).alias("idx"), "text", F.pmod("conv_id", F.lit(5)).alias("grp"))


def counted_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Replies with ``n``, the number of their references."""
    rows = replies(spark, folder)
    turns = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("_same"))
    totals = turns.groupBy("conv_id").agg(F.sum("_same").alias("_all"))
    return rows.join(turns, ["conv_id", "turn"]).join(totals, "conv_id").withColumn("n", F.col("_all") - F.col("_same"))


def reply_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each reply with each of its references, a row a pair; ``ref`` is the reference's place in their order.

    A conversation is cut into blocks, and block meets block: no row and no task holds a whole conversation.
    """
    rows = ordered.number_rows(counted_replies(spark, folder), "turn", "_at", by="conv_id")
    blocks = (F.col("_all") / BLOCK).cast("int") + 1
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("turn"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left = rows.select("conv_id", "turn", "idx", "text", "grp", "_same", F.col("_block").alias("_l"), F.col("_other").alias("_r"))
    right = rows.select("conv_id", F.col("turn").alias("_turn"), F.col("text").alias("reference"), "_at", F.col("_block").alias("_r"), F.col("_other").alias("_l"))
    both = left.join(right, ["conv_id", "_l", "_r"]).where("turn <> _turn")
    ref = F.when(F.col("_turn") < F.col("turn"), F.col("_at")).otherwise(F.col("_at") - F.col("_same"))
    return both.select("conv_id", "turn", "idx", "text", "reference", ref.alias("ref"), "grp")


REPLIES = """
replies AS (SELECT p.conv_id * 10000 + p.turn AS idx, p.text,
       coalesce(list(o.text ORDER BY o.turn) FILTER (WHERE o.turn IS NOT NULL), []) AS refs, p.conv_id % 5 AS grp
  FROM conversations p
  LEFT JOIN conversations o ON o.conv_id = p.conv_id AND o.turn <> p.turn AND o.role = 'assistant'
  WHERE p.role = 'assistant' GROUP BY p.conv_id, p.turn, p.text)"""


def normalized(column: str) -> str:
    punctuation = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
    return f"trim(regexp_replace(translate(lower({column}), '{punctuation}', ''), '{SPACES}', ' ', 'g'))"


# --- logits ---------------------------------------------------------------------------

LOGIT_SCALE = 8.0  # stored vectors are short; scaled, their softmax is far from flat


def logit_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Student logits of example v are vector v, teacher logits vector v + 1."""
    vectors = table(spark, folder, "embeddings")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * LOGIT_SCALE)
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.lit(-100)).otherwise(F.col("label"))
    place = lambda v: [F.shiftright(v, 3).alias("example_id"), F.pmod(v, F.lit(8)).cast("int").alias("pos")]
    student = vectors.select(*place(F.col("vec_id")), scaled.alias("logits"), label.alias("label"))
    teacher = vectors.where("vec_id > 0").select(*place(F.col("vec_id") - 1), scaled.alias("logits"))
    return student, teacher


LOGITS = """
scaled AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 8.0) AS logits,
       CASE WHEN vec_id % 7 = 0 THEN -100 ELSE label END AS label FROM embeddings),
pairs AS (SELECT s.vec_id // 8 AS example_id, CAST(s.vec_id % 8 AS INTEGER) AS pos, s.label,
       s.logits AS student, t.logits AS teacher
  FROM scaled s JOIN scaled t ON t.vec_id = s.vec_id + 1),
logp AS (SELECT *, list_max(student) + ln(list_sum(list_transform(student, lambda x: exp(x - list_max(student))))) AS zs,
       list_max(teacher) + ln(list_sum(list_transform(teacher, lambda x: exp(x - list_max(teacher))))) AS zt FROM pairs),
long AS (SELECT example_id, pos, label, exp(unnest(student) - zs) AS q, unnest(student) - zs AS lq,
       exp(unnest(teacher) - zt) AS p, unnest(teacher) - zt AS lp FROM logp)"""


# --- rollouts -------------------------------------------------------------------------

# One rollout is a user's events inside a window of 1,024 event ids: at most 1,024 tokens.
ROLLOUT_TOKENS = [
    "user_id * 1000000 + shiftright(event_id, 10) AS rollout_id",
    "event_id",
    "CAST(1 + event_id % 97 AS INT) AS token",
    "CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS m",
    "-value / 40 AS t_lp",
    "-(value + event_id % 13) / 50 AS s_lp",
    "-(value + event_id % 5) / 45 AS r_lp",
]


def rollout_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*ROLLOUT_TOKENS)


def rollouts(spark: SparkSession, folder: str) -> DataFrame:
    # The number packed into rollout_id is shared by users once event ids are large: it names a rollout, the pair is its key.
    tokens = table(spark, folder, "events").selectExpr("user_id AS _user", "shiftright(event_id, 10) AS _window", *ROLLOUT_TOKENS)
    packed = tokens.groupBy("_user", "_window", "rollout_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "token", "m", "t_lp", "s_lp", "r_lp"))).alias("_t")
    )
    part = lambda n: F.transform("_t", lambda x: x[n])
    return packed.select(
        "rollout_id", part("token").alias("response"), part("m").alias("mask"), part("t_lp").alias("t_rewards"),
        part("s_lp").alias("logprobs"), part("r_lp").alias("rollout_logprobs"),
    )


ROLLOUT_SQL = "tokens AS (SELECT {}, row_number() OVER (PARTITION BY user_id, event_id >> 10 ORDER BY event_id) AS t FROM events)".format(
    ", ".join(ROLLOUT_TOKENS).replace("shiftright(event_id, 10)", "(event_id >> 10)")
)


# --- runs -----------------------------------------------------------------------------

ATTEMPTS = [
    "user_id AS run_id",
    "event_id AS attempt_no",
    "event_type = 'error' AS failed",
    "CASE WHEN event_type = 'error' THEN concat('h', CAST(CAST(floor(value / 40) AS INT) AS STRING)) END AS error_hash",
]
ATTEMPTS_SQL = "attempts AS (SELECT {} FROM events)".format(", ".join(ATTEMPTS).replace("AS STRING", "AS VARCHAR"))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*ATTEMPTS)


# Log lines from events: an attempt is a user's events inside a window of 2,048 event ids.
MESSAGES = [
    "step finished, loss 2.31",
    "[rank0]: RuntimeError: CUDA out of memory. Tried to allocate 2 GiB",
    "kernel: Out of memory: Killed process 4242 (python)",
    "WARNING: retrying download",
    "[rank1] INFO: loading tokenizer",
    "WARNING: error while reading shard",
    "requests timed out for https://huggingface.co/api",
    "ConnectionError: Connection reset by peer",
    "ModuleNotFoundError: No module named apex",
    "bind failed: Address already in use",
    "NCCL watchdog abort on rank 3",
    "FileNotFoundError: [Errno 2] data.txt",
    "json.decoder.JSONDecodeError: Expecting value",
    "Unexpected key in checkpoint state",
    "RuntimeError: mat1 and mat2 shapes cannot be multiplied",
    "AssertionError: batch is empty",
    "Received SIGTERM, stopping",
    "loss is nan at step 12",
    "No space left on device",
    "Loss scale is at minimum, cannot decrease",
]
_WHENS = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES))
LOG_LINES = [
    "user_id AS run_id",
    "CAST(shiftright(event_id, 11) AS INT) AS attempt",
    "event_id AS line_no",
    f"CASE (event_id * 7 + user_id * 3) % 61 {_WHENS} ELSE concat('iter ', CAST(event_id AS STRING), ' ', event_type, ' done') END AS raw",
]
LOG_SQL = "log AS (SELECT {} FROM events)".format(
    ", ".join(LOG_LINES).replace("shiftright(event_id, 11)", "(event_id >> 11)").replace("AS STRING", "AS VARCHAR")
)


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*LOG_LINES)


def event_seconds(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their time as whole epoch seconds, independent of the session's zone."""
    events = table(spark, folder, "events")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return events.withColumn("second", seconds)
