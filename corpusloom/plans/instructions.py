"""Instruction queries: normalising, prompts, splits, examples, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays
from corpusloom.functions.text import (
    CHAT_OPEN,
    CHAT_TURN,
    INPUT_HEAD,
    INSTRUCTION_HEAD,
    PREAMBLE,
    PREAMBLE_INPUT,
    REQUEST,
    RESPONSE_HEAD,
    apply_prompt_template,
    as_reference_list,
    inline_newlines,
    in_active_window,
    significant,
)
from corpusloom.operators import batching, examples, ordered, prepare, select, tokens
from corpusloom.plans.binding import (
    PAIR_IDS,
    PAIRS,
    UPSTREAM,
    documents,
    joined_ids,
    md5_ids,
    pair_ids,
    pairs,
    scratch,
    table,
    words_of,
)
from corpusloom.sources import readers, writers

MAX_LENGTH, MAX_PROMPT, PAD = 64, 16, 0
SAMPLE_LENGTH = 4096  # above any prompt and response of the tables together


def size_of(ids):
    return F.size(ids).cast("long")


def _normalize(spark, folder):
    rows = prepare.normalize_instructions(table(spark, folder, "conversations").selectExpr(*UPSTREAM))
    return rows.select("row_id", F.md5("instruction").alias("instruction_md5"), "input", F.md5("output").alias("output_md5"))


def _template(spark, folder):
    rows = pairs(spark, folder)
    shown = lambda family: F.md5(apply_prompt_template(F.col("instruction"), F.col("input"), family))
    return rows.select("pair_id", shown("plain").alias("plain_md5"), shown("chat").alias("chat_md5"))


def _read_instructions(spark, folder):
    path = scratch(spark, "raw")
    pairs(spark, folder).orderBy("pair_id").select("instruction", "input", "output").write.json(path)
    rows = readers.read_instructions(spark, path)
    return rows.where("_corrupt IS NULL").select(
        "row_id", F.md5("instruction").alias("instruction_md5"), "input", F.md5("output").alias("output_md5"))


def _numbered(spark, folder) -> DataFrame:
    return ordered.number_rows(pairs(spark, folder), "pair_id")


NUMBERED = f"{PAIRS}, numbered AS (SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS row_id FROM pairs)"


def _write_split(spark, folder):
    path = scratch(spark, "split")
    rows = prepare.split_head(_numbered(spark, folder), 40)
    rows = rows.withColumn("prompt", apply_prompt_template(F.col("instruction"), F.col("input")))
    writers.write_split_jsonl(rows, path)
    back = spark.read.schema("instruction string, prompt string, input string, output string, split string").json(path)
    return back.select("split", F.md5("prompt").alias("prompt_md5"), F.md5("output").alias("output_md5"))


def _read_eval(spark, folder):
    path = scratch(spark, "eval")
    rows = _numbered(spark, folder).select("row_id", inline_newlines(F.col("instruction")).alias("prompt"), "output", "instruction")
    kind = F.pmod("row_id", F.lit(3))
    line = (
        F.when(kind == 0, F.to_json(F.struct("prompt", F.array("output", "instruction").alias("output"))))
        .when(kind == 1, F.to_json(F.struct("prompt", "output")))
        .otherwise(F.to_json(F.struct("prompt")))
    )
    ordered_lines = rows.orderBy("row_id")
    ordered_lines.select(line.alias("value")).write.text(f"{path}/valid_small.jsonl")
    ordered_lines.select(F.lit("{}").alias("value")).write.text(f"{path}/valid.jsonl")
    found = readers.read_eval(spark, path, "valid", family="small")
    return found.select("idx", F.md5("prompt").alias("prompt_md5"), F.coalesce(size_of("references"), F.lit(0).cast("long")).alias("n"),
                        F.md5(F.array_join("references", "|")).alias("references_md5"))


def _read_prompts(spark, folder):
    path = scratch(spark, "prompts")
    rows = _numbered(spark, folder).orderBy("row_id")
    rows.select(F.concat(F.lit("  "), inline_newlines(F.col("instruction")), F.lit(" \t")).alias("value")).write.text(path)
    return readers.read_prompts_txt(spark, path).select("idx", F.md5("prompt").alias("prompt_md5"))


def _encoded(spark, folder) -> DataFrame:
    rows = pairs(spark, folder).withColumn("instruction", F.concat("instruction", F.lit(" ")))
    return prepare.encode_pairs(rows, "instruction", "output", tokens.hashed_word_ids, tokens.HASH_EOS, MAX_PROMPT)


def _split_response(spark, folder):
    return _encoded(spark, folder).select(
        "pair_id", joined_ids("prompt_ids").alias("prompt_md5"), joined_ids("response_ids").alias("response_md5"))


def _truncate(spark, folder):
    ids = pair_ids(spark, folder)
    return ids.select(
        "pair_id",
        joined_ids(arrays.truncate_ids(F.col("prompt_ids"), 8, "head")).alias("head_md5"),
        joined_ids(arrays.truncate_ids(F.col("prompt_ids"), 8, "tail")).alias("tail_md5"),
    )


def _reserve(spark, folder):
    kept = arrays.reserve_response(F.col("response_ids"), MAX_LENGTH, MAX_PROMPT)
    return pair_ids(spark, folder).select("pair_id", size_of(kept).alias("n"), joined_ids(kept).alias("ids_md5"))


def _pair(spark, folder):
    joined = pair_ids(spark, folder).withColumn("ids", prepare.encode_pair(F.col("prompt_ids"), F.col("response_ids")))
    parts = joined.withColumn("d", prepare.decode_pair(F.col("ids")))
    return parts.select("pair_id", joined_ids("ids").alias("ids_md5"), joined_ids("d.prompt_ids").alias("prompt_md5"),
                        joined_ids("d.response_ids").alias("response_md5"))


def _prompt_only(spark, folder):
    return prepare.prompt_only(pair_ids(spark, folder), 24).select("pair_id", size_of("prompt_ids").alias("n"))


def _lm_example(spark, folder):
    made = examples.lm_example(pair_ids(spark, folder), MAX_LENGTH, PAD, max_prompt_length=MAX_PROMPT)
    columns = ("input_ids", "attention_mask", "position_ids", "label", "loss_mask", "gen_ids", "gen_mask")
    return made.select("pair_id", *[joined_ids(c).alias(c) for c in columns])


def _left_pad(spark, folder):
    shown = examples.prompt_batch(pair_ids(spark, folder), MAX_PROMPT, PAD)
    return shown.select("pair_id", joined_ids("input_ids").alias("input_ids"), joined_ids("attention_mask").alias("attention_mask"),
                        size_of("rest_ids").alias("rest"))


def _padded(spark, folder) -> DataFrame:
    """Prompts and responses padded to the longest of their batch of conversations."""
    ids = pair_ids(spark, folder).select("pair_id", F.pmod("conv_id", F.lit(16)).alias("grp"), F.col("prompt_ids").alias("query"), F.col("response_ids").alias("rest"))
    return examples.pad_to_group_max(ids, "grp", left={"query": PAD}, right={"rest": PAD}).drop("grp")


PADDED = f"""{PAIR_IDS}, wide AS (SELECT *, max(len(prompt_ids)) OVER g AS nq, max(len(response_ids)) OVER g AS nr FROM ids WINDOW g AS (PARTITION BY conv_id % 16)),
padded AS (SELECT pair_id, nq, nr,
    list_concat(list_transform(range(nq - len(prompt_ids)), lambda i: 0), prompt_ids) AS query,
    list_concat(response_ids, list_transform(range(nr - len(response_ids)), lambda i: 0)) AS rest FROM wide),
whole AS (SELECT pair_id, query, rest, nq, nr, list_concat(query, rest) AS x FROM padded)"""


def _prompt_response(spark, folder):
    made = examples.prompt_response_example(_padded(spark, folder), "query", "rest", PAD)
    columns = ("input_ids", "label", "attention_mask", "loss_mask")
    return made.select("pair_id", *[joined_ids(c).alias(c) for c in columns])


def _positions(spark, folder):
    made = examples.prompt_response_example(_padded(spark, folder), "query", "rest", PAD)
    return made.select("pair_id", joined_ids("position_ids").alias("position_ids"))


def _compact(spark, folder):
    made = examples.compact_sample(_padded(spark, folder), "query", "rest", PAD, SAMPLE_LENGTH)
    return made.select("pair_id", *[joined_ids(c).alias(c) for c in ("input_ids", "attention_mask", "position_ids", "label")])


def _response_mask(spark, folder):
    made = examples.response_mask(_padded(spark, folder), "query", "rest", PAD)
    return made.select("pair_id", joined_ids("mask").alias("mask"), F.col("lens").cast("long").alias("lens"))


def _reference_list(spark, folder):
    rows = pairs(spark, folder)
    many = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.array("output", "instruction"))
    single = F.when(F.pmod("conv_id", F.lit(3)) == 1, F.col("output"))
    found = as_reference_list(single, many)
    return rows.select("pair_id", size_of(found).alias("n"), F.md5(F.array_join(found, "|")).alias("references_md5"))


def _label_map(spark, folder):
    rows = pairs(spark, folder).select("pair_id", tokens.hashed_word_ids(F.col("output")).alias("response_ids"), "output")
    found = examples.label_map(rows, "pair_id", "response_ids", "output")
    return found.select("token", F.md5("answer").alias("answer_md5"))


def _split(spark, folder):
    return prepare.split_head(_numbered(spark, folder), 40).select("pair_id", "row_id", "split")


def _cap(spark, folder):
    return prepare.cap(_numbered(spark, folder), 100).select("pair_id", "row_id")


def _sources(spark, folder) -> dict[str, DataFrame]:
    docs = documents(spark, folder).select("doc_id", "lang")
    part = lambda lang: ordered.number_rows(docs.where(F.col("lang") == lang), "doc_id")
    return {lang: part(lang).drop("lang") for lang in ("en", "fr", "de", "es")}


def _combine(spark, folder):
    return prepare.combine_sources(_sources(spark, folder), dev_from="en", dev_num=30)


def _split_from(spark, folder):
    """The valid split of one half of the documents replaces that of the other."""
    docs = documents(spark, folder).select("doc_id", "lang")
    half = lambda english: ordered.number_rows(docs.where((F.col("lang") == "en") == english), "doc_id").drop("lang")
    return prepare.with_split_from(prepare.split_head(half(False), 10), prepare.split_head(half(True), 25))


def _batches(spark, folder, **kwargs):
    docs = documents(spark, folder).select("doc_id")
    return batching.plan_batches(docs, "doc_id", world=3, batch=16, seed=10, epoch=2, **kwargs).select(
        "doc_id", F.col("rank").cast("long").alias("rank"), "batch", F.col("slot").cast("long").alias("slot"))


def _training_plan(spark, folder):
    rows = documents(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sized = rows.select("source", (F.col("n") * 100).alias("n"), F.lit(2).alias("batch"), F.lit(4).alias("world"), F.lit(2).alias("ga"),
                        F.lit(3).alias("epochs"), F.lit(1000).alias("steps"))
    by_epochs = batching.training_plan(sized, "n", "batch", "world", "ga", epochs="epochs")
    by_steps = batching.training_plan(sized, "n", "batch", "world", "ga", total_steps="steps")
    shown = lambda df, kind: df.select("source", F.lit(kind).alias("given"), "steps_per_epoch", "planned_steps", "planned_epochs")
    return shown(by_epochs, "epochs").unionByName(shown(by_steps, "steps"))


def _zip_cycle(spark, folder):
    docs = documents(spark, folder).select(ordered.int_div(F.col("doc_id"), 8).alias("batch"))
    main = docs.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))
    turns = ordered.number_rows(pairs(spark, folder), "pair_id").select(ordered.int_div(F.col("row_id"), 16).alias("batch"), "pair_id")
    aux = turns.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.min("pair_id").alias("first"))
    return batching.zip_cycle(main, aux)


def _quota(spark, folder):
    docs = documents(spark, folder).select("doc_id", F.pmod("doc_id", F.lit(4)).alias("rank"))
    return batching.rollout_quota(docs, "doc_id", total=202, devices=4)


def _replay(spark, folder):
    docs = documents(spark, folder).select("doc_id", "lang")
    return select.replay_sample(docs, capacity=100, k=10, seed=7, arrival="doc_id", row_id="doc_id")


def _active(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", F.pmod("event_id", F.lit(5)).alias("w"))
    window = F.element_at(F.array(*[F.lit(x) for x in WINDOWS]), (F.col("w") + 1).cast("int"))
    return events.select("event_id", in_active_window(F.col("ts"), window).alias("active"))


WINDOWS = ("22:00-08:00", "9:30-17:45", "12:00-12:00", "noon", " 00:00-06:15 ")


def _significant(spark, folder):
    events = table(spark, folder, "events").select("event_id", (F.col("value") * F.pow(F.lit(10.0), F.pmod("event_id", F.lit(7)) - 3)).alias("x"))
    return events.select("event_id", F.round(significant(F.col("x")), 9).alias("shown"))


QUERIES = {
    "src1_read_instructions": _read_instructions,
    "src2_read_eval": _read_eval,
    "src4_read_prompts_txt": _read_prompts,
    "snk1_write_split_jsonl": _write_split,
    "prj1_normalize_instructions": _normalize,
    "prj2_apply_prompt_template": _template,
    "prj6_split_response": _split_response,
    "prj7_truncate_ids": _truncate,
    "prj8_reserve_response": _reserve,
    "prj9_encode_decode_pair": _pair,
    "prj10_prompt_only": _prompt_only,
    "prj11_lm_example": _lm_example,
    "prj12_left_pad": _left_pad,
    "prj13_prompt_response_example": _prompt_response,
    "prj14_position_ids": _positions,
    "prj15_compact_sample": _compact,
    "prj17_as_reference_list": _reference_list,
    "prj19_label_map": _label_map,
    "prj21_in_active_window": _active,
    "prj25_response_mask": _response_mask,
    "spl2_split_head": _split,
    "spl3_cap": _cap,
    "spl4_rollout_quota": _quota,
    "set1_combine_sources": _combine,
    "set2_with_split_from": _split_from,
    "bat1_plan_batches": lambda s, d: _batches(s, d),
    "bat1_plan_batches_short": lambda s, d: _batches(s, d, drop_short=True),
    "bat1_plan_batches_padded": lambda s, d: _batches(s, d, drop_last=False),
    "bat2_training_plan": _training_plan,
    "bat3_zip_cycle": _zip_cycle,
    "smp1_replay_sample": _replay,
    "fmt_significant": _significant,
}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_sql(family: str) -> str:
    start, end = (CHAT_OPEN, CHAT_TURN) if family == "chat" else ("", "")
    return (
        f"CASE WHEN length(input) > 0 THEN concat({_sql(start + PREAMBLE + PREAMBLE_INPUT + REQUEST + INSTRUCTION_HEAD)}, instruction, "
        f"{_sql(INPUT_HEAD)}, input, {_sql(RESPONSE_HEAD + end)}) "
        f"ELSE concat({_sql(start + PREAMBLE + REQUEST + INSTRUCTION_HEAD)}, instruction, {_sql(RESPONSE_HEAD + end)}) END"
    )


def _listed(expression: str, n: int | str) -> str:
    return md5_ids(f"list_transform(range({n}), lambda i: {expression})")


_SHUFFLED = """k AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id, '|10|2'))) - 1 AS pos, count(*) OVER () AS n FROM documents)"""
_DEALT = "doc_id, pos % 3 AS rank, pos // 3 // 16 AS batch, pos // 3 % 16 AS slot"
_OUT = "coalesce(nullif(response, ''), nullif(output, ''), answer)"
_INS = "coalesce(nullif(instruction, ''), nullif(prompt, ''), nullif(question, ''))"
_LABELS = "CASE WHEN i < greatest(len(prompt_ids), 1) - 1 OR i >= n - 1 THEN -100 ELSE full_ids[i + 2] END"

ORACLES = {
    "src1_read_instructions": f"""WITH {NUMBERED} SELECT row_id, md5(instruction) AS instruction_md5, input, md5(output) AS output_md5
        FROM numbered""",
    "src2_read_eval": f"""WITH {NUMBERED} SELECT row_id AS idx, md5(instruction) AS prompt_md5,
        CASE row_id % 3 WHEN 0 THEN CAST(2 AS BIGINT) WHEN 1 THEN 1 ELSE 0 END AS n,
        CASE row_id % 3 WHEN 0 THEN md5(concat(output, '|', instruction)) WHEN 1 THEN md5(output) END AS references_md5 FROM numbered""",
    "src4_read_prompts_txt": f"""WITH {NUMBERED} SELECT row_id AS idx,
        md5(replace(regexp_replace(replace(instruction, chr(10), '<n>'), '^\\s+|\\s+$', '', 'g'), '<n>', chr(10))) AS prompt_md5 FROM numbered""",
    "snk1_write_split_jsonl": f"""WITH {NUMBERED} SELECT CASE WHEN row_id < 40 THEN 'valid' ELSE 'train' END AS split,
        md5({_prompt_sql('plain')}) AS prompt_md5, md5(output) AS output_md5 FROM numbered""",
    "prj1_normalize_instructions": f"""WITH up AS (SELECT {', '.join(UPSTREAM)} FROM conversations)
        SELECT row_id, md5({_INS}) AS instruction_md5, coalesce(nullif(context, ''), nullif(input, ''), '') AS input, md5({_OUT}) AS output_md5
        FROM up WHERE {_INS} IS NOT NULL AND {_OUT} IS NOT NULL""",
    "prj2_apply_prompt_template": f"WITH {PAIRS} SELECT pair_id, md5({_prompt_sql('plain')}) AS plain_md5, md5({_prompt_sql('chat')}) AS chat_md5 FROM pairs",
    "prj6_split_response": f"""WITH {PAIRS}, e AS (SELECT pair_id, {words_of("concat(instruction, ' ')")} AS p,
        list_append({words_of("concat(instruction, ' ', output)")}, 16777216) AS f FROM pairs)
        SELECT pair_id, {md5_ids('p[1:16]')} AS prompt_md5, {md5_ids('f[len(p) + 1:]')} AS response_md5 FROM e""",
    "prj7_truncate_ids": f"""WITH {PAIR_IDS} SELECT pair_id, {md5_ids('prompt_ids[1:8]')} AS head_md5,
        {md5_ids('prompt_ids[greatest(len(prompt_ids) - 7, 1):]')} AS tail_md5 FROM ids""",
    "prj8_reserve_response": f"WITH {PAIR_IDS} SELECT pair_id, len(response_ids[1:48]) AS n, {md5_ids('response_ids[1:48]')} AS ids_md5 FROM ids",
    "prj9_encode_decode_pair": f"""WITH {PAIR_IDS} SELECT pair_id, {md5_ids('list_concat(prompt_ids, [-1], response_ids)')} AS ids_md5,
        {md5_ids('prompt_ids')} AS prompt_md5, {md5_ids('response_ids')} AS response_md5 FROM ids""",
    "prj10_prompt_only": f"WITH {PAIR_IDS} SELECT pair_id, len(prompt_ids) AS n FROM ids WHERE len(prompt_ids) < 24",
    "prj11_lm_example": f"""WITH {PAIR_IDS}, f AS (SELECT *, list_concat(prompt_ids, response_ids)[1:64] AS full_ids FROM ids),
        g AS (SELECT *, len(full_ids) AS n, prompt_ids[greatest(len(prompt_ids) - 15, 1):] AS shown FROM f)
        SELECT pair_id, {_listed('CASE WHEN i < n - 1 THEN full_ids[i + 1] ELSE 0 END', 64)} AS input_ids,
          {_listed('CASE WHEN i < n - 1 THEN 1 ELSE 0 END', 64)} AS attention_mask,
          {_listed('CASE WHEN i < n - 1 THEN i ELSE 0 END', 64)} AS position_ids, {_listed(_LABELS, 64)} AS label,
          {_listed('CASE WHEN i < greatest(len(prompt_ids), 1) - 1 OR i >= n - 1 THEN 0 ELSE 1 END', 64)} AS loss_mask,
          {_listed('CASE WHEN i < 16 - len(shown) THEN 0 ELSE shown[i - 15 + len(shown)] END', 16)} AS gen_ids,
          {_listed('CASE WHEN i < 16 - len(shown) THEN 0 ELSE 1 END', 16)} AS gen_mask FROM g""",
    "prj12_left_pad": f"""WITH {PAIR_IDS}, s AS (SELECT *, prompt_ids[1:16] AS shown FROM ids)
        SELECT pair_id, {_listed('CASE WHEN i < 16 - len(shown) THEN 0 ELSE shown[i - 15 + len(shown)] END', 16)} AS input_ids,
          {_listed('CASE WHEN i < 16 - len(shown) THEN 0 ELSE 1 END', 16)} AS attention_mask,
          greatest(len(prompt_ids) - 16, 0) AS rest FROM s""",
    "prj13_prompt_response_example": f"""WITH {PADDED} SELECT pair_id, {md5_ids('x[1:len(x) - 1]')} AS input_ids,
        {_listed('CASE WHEN i < nq - 1 OR x[i + 2] = 0 THEN -100 ELSE x[i + 2] END', 'len(x) - 1')} AS label,
        {_listed('CASE WHEN x[i + 1] <> 0 THEN 1 ELSE 0 END', 'len(x) - 1')} AS attention_mask,
        {_listed('CASE WHEN i < nq - 1 OR x[i + 2] = 0 THEN 0 ELSE 1 END', 'len(x) - 1')} AS loss_mask FROM whole""",
    "prj14_position_ids": f"""WITH {PADDED} SELECT pair_id,
        {_listed('CASE WHEN x[i + 1] = 0 THEN 0 ELSE len(list_filter(x[1:i + 1], lambda v: v <> 0)) - 1 END', 'len(x) - 1')} AS position_ids FROM whole""",
    "prj15_compact_sample": f"""WITH {PADDED}, c AS (SELECT pair_id, list_filter(query, lambda v: v <> 0) AS q, list_filter(rest, lambda v: v <> 0) AS r FROM padded),
        d AS (SELECT pair_id, q, list_concat(q, r) AS x FROM c)
        SELECT pair_id, {_listed('CASE WHEN i < len(x) THEN x[i + 1] ELSE 0 END', SAMPLE_LENGTH)} AS input_ids,
          {_listed('CASE WHEN i < len(x) THEN 1 ELSE 0 END', SAMPLE_LENGTH)} AS attention_mask,
          {_listed('CASE WHEN i < len(x) THEN i ELSE 0 END', SAMPLE_LENGTH)} AS position_ids,
          {_listed('CASE WHEN i >= len(q) AND i < len(x) THEN x[i + 1] ELSE -100 END', SAMPLE_LENGTH)} AS label FROM d""",
    "prj17_as_reference_list": f"""WITH {PAIRS} SELECT pair_id, CASE conv_id % 3 WHEN 0 THEN CAST(2 AS BIGINT) WHEN 1 THEN 1 END AS n,
        CASE conv_id % 3 WHEN 0 THEN md5(concat(output, '|', instruction)) WHEN 1 THEN md5(output) END AS references_md5 FROM pairs""",
    "prj19_label_map": f"""WITH {PAIRS}, t AS (SELECT pair_id, output, ({words_of('output')})[1] AS token FROM pairs)
        SELECT token, md5(max_by(output, pair_id)) AS answer_md5 FROM t WHERE token IS NOT NULL GROUP BY 1""",
    "prj21_in_active_window": """WITH e AS (SELECT event_id, event_id % 5 AS w, hour(ts) * 60 + minute(ts) AS m FROM events)
        SELECT event_id, CASE w WHEN 0 THEN m >= 1320 OR m < 480 WHEN 1 THEN m >= 570 AND m < 1065
          WHEN 4 THEN m < 375 ELSE true END AS active FROM e""",
    "prj25_response_mask": f"""WITH {PADDED} SELECT pair_id, {_listed('CASE WHEN x[i + nq] <> 0 THEN 1 ELSE 0 END', 'nr')} AS mask,
        len(list_filter(x[nq:nq + nr - 1], lambda v: v <> 0)) AS lens FROM whole""",
    "spl2_split_head": f"WITH {NUMBERED} SELECT pair_id, row_id, CASE WHEN row_id < 40 THEN 'valid' ELSE 'train' END AS split FROM numbered",
    "spl3_cap": f"WITH {NUMBERED} SELECT pair_id, row_id FROM numbered WHERE row_id < 100",
    "spl4_rollout_quota": """SELECT doc_id, rank FROM (SELECT doc_id, doc_id % 4 AS rank,
        row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS n FROM documents) WHERE n <= 50""",
    "set1_combine_sources": """SELECT doc_id, row_id, CASE WHEN source = 'en' AND row_id < 30 THEN 'valid' ELSE 'train' END AS split, source FROM (
        SELECT doc_id, lang AS source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_id FROM documents)""",
    "set2_with_split_from": """WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang = 'en' ORDER BY doc_id) - 1 AS row_id FROM documents)
        SELECT doc_id, row_id, 'train' AS split FROM n WHERE lang <> 'en' AND row_id >= 10
        UNION ALL SELECT doc_id, row_id, 'valid' FROM n WHERE lang = 'en' AND row_id < 25""",
    "bat1_plan_batches": f"WITH {_SHUFFLED} SELECT {_DEALT} FROM k WHERE pos < n // 3 * 3",
    "bat1_plan_batches_short": f"WITH {_SHUFFLED} SELECT {_DEALT} FROM k WHERE pos < n // 3 // 16 * 16 * 3",
    "bat1_plan_batches_padded": f"""WITH {_SHUFFLED}, w AS (SELECT doc_id, pos, n FROM k UNION ALL SELECT doc_id, pos + n, n FROM k)
        SELECT {_DEALT} FROM w WHERE pos < (n + 2) // 3 * 3""",
    "bat2_training_plan": """WITH c AS (SELECT source, count(*) * 100 // 16 AS p FROM documents GROUP BY 1)
        SELECT source, 'epochs' AS given, p AS steps_per_epoch, p * 3 AS planned_steps, CAST(3 AS BIGINT) AS planned_epochs FROM c
        UNION ALL SELECT source, 'steps', p, 1000, CAST(ceil(1000.0 / p) AS BIGINT) FROM c""",
    "bat3_zip_cycle": f"""WITH {NUMBERED}, m AS (SELECT doc_id // 8 AS batch, count(*) AS rows FROM documents GROUP BY 1),
        a AS (SELECT row_id // 16 AS batch, count(*) AS rows, min(pair_id) AS first FROM numbered GROUP BY 1)
        SELECT m.batch, m.rows, a.batch AS aux_batch, a.rows AS aux_rows, a.first AS aux_first
        FROM m JOIN a ON m.batch % (SELECT max(batch) + 1 FROM a) = a.batch""",
    "smp1_replay_sample": """SELECT doc_id, lang FROM (SELECT * FROM documents ORDER BY doc_id DESC LIMIT 100)
        ORDER BY md5(concat(doc_id, '|7|0')) LIMIT 10""",
    "fmt_significant": """WITH x AS (SELECT event_id, value * pow(10.0, event_id % 7 - 3) AS x FROM events),
        s AS (SELECT event_id, x, pow(10.0, 2 - floor(log10(abs(x)))) AS s FROM x)
        SELECT event_id, round(CASE WHEN x = 0 THEN x ELSE round_even(x * s, 0) / s END, 9) AS shown FROM s""",
}
