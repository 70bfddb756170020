"""Corpus queries: line formats, tokens, prefix sums, packing, token datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import NEWLINE_SENTINEL, escape_newlines, short_count, unescape_newlines
from corpusloom.operators import metrics, ordered, packing, prepare, tokens
from corpusloom.plans.binding import (
    HASHED_IDS,
    SPACES,
    WORDS,
    documents,
    joined_ids,
    md5_ids,
    rounded,
    scratch,
    table,
)
from corpusloom.sources import readers, token_files, writers

CHUNK = 512
DEV_CHUNKS = 100


def tokenized(spark: SparkSession, folder: str) -> DataFrame:
    """Documents through the corpus line format into ids, with a count that needs no digest."""
    docs = documents(spark, folder).select("doc_id", unescape_newlines(escape_newlines(F.col("text"))).alias("text"))
    return tokens.tokenize(docs, "text")


def word_count():
    return F.size(tokens.words(F.col("text"))) + 1


def packed(spark: SparkSession, folder: str, **kwargs) -> DataFrame:
    return packing.pack(tokenized(spark, folder), "doc_id", "ids", CHUNK, size=word_count(), **kwargs)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus to fixed-length chunks to length statistics by split."""
    chunks = packed(spark, folder, dev_num=DEV_CHUNKS)
    stats = metrics.length_stats(chunks, "ids")
    return stats.select("split", "rows", rounded(F.col("ids_mean")).alias("ids_mean"), "ids_max", "ids_min")


def numbered_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Token sequences of all documents by dense id."""
    return _sequences(documents(spark, folder))


def _sequences(docs: DataFrame) -> DataFrame:
    rows = ordered.number_rows(docs.select("doc_id", "lang", "text"), "doc_id", "seq_id")
    return rows.select("seq_id", "lang", tokens.hashed_word_ids(F.col("text")).alias("ids"))


SEQUENCES = f"""seqs AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq_id, lang, {HASHED_IDS} AS ids
  FROM documents)"""

STREAM = f"""stream AS (SELECT id, (row_number() OVER (ORDER BY doc_id, pos) - 1) AS n FROM (
  SELECT doc_id, unnest(list_append({HASHED_IDS}, 16777216)) AS id,
         generate_subscripts(list_append({HASHED_IDS}, 16777216), 1) AS pos FROM documents)),
chunks AS (SELECT n // {CHUNK} AS chunk, count(*) AS n, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY n)) AS ids_md5
  FROM stream GROUP BY 1 HAVING count(*) = {CHUNK})"""


def _read_corpus(spark, folder):
    path = scratch(spark, "corpus")
    writers.write_corpus(documents(spark, folder), path, order="doc_id")
    return readers.read_corpus(spark, path).select("doc_id", F.md5("text").alias("text_md5"))


def _read_corpus_cap(spark, folder):
    path = scratch(spark, "corpus")
    writers.write_corpus(documents(spark, folder), path, order="doc_id")
    return readers.read_corpus(spark, path, max_docs=150).select("doc_id", F.length("text").cast("long").alias("n"))


def _write_corpus(spark, folder):
    path = scratch(spark, "corpus")
    writers.write_corpus(documents(spark, folder), path)
    return spark.read.option("lineSep", "\n").text(path).groupBy(F.md5("value").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


def _escape(spark, folder):
    line = escape_newlines(F.col("text"))
    return documents(spark, folder).select(
        "doc_id", F.md5(line).alias("line_md5"), F.md5(unescape_newlines(line)).alias("text_md5"),
        (F.size(F.split(line, rf"\Q{NEWLINE_SENTINEL}\E")) - 1).cast("long").alias("breaks"),
    )


def _tokenize(spark, folder):
    ids = tokens.tokenize(documents(spark, folder), "text")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), joined_ids("ids").alias("ids_md5"))


def _tokenize_bytes(spark, folder):
    ids = tokens.encode(F.col("text"), tokens.ByteEncoder())
    staged = documents(spark, folder).select("doc_id", ids.alias("ids"))
    shown = F.array_join(F.transform("ids", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return staged.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(shown).alias("bytes_md5"))


def _vocab(spark, folder):
    return tokens.build_vocab(documents(spark, folder), "text", min_count=2).select("token", "count", "id")


def _encode_words(spark, folder):
    docs = documents(spark, folder)
    vocab = tokens.build_vocab(docs, "text", min_count=3)
    ids = tokens.encode_words(docs, "doc_id", "text", vocab, unk_id=-1)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), joined_ids("ids").alias("ids_md5"))


def _prefix(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    both = ordered.prefix_sum(docs, "doc_id", F.col("n_chars"), "at")
    return ordered.prefix_sum(both, "doc_id", F.col("n_chars"), "at_in_lang", by="lang").drop("n_chars")


def _row_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return ordered.number_sorted(docs, "lang", F.desc("n_chars"), "doc_id").select("doc_id", "row_id")


def _pack(spark, folder):
    chunks = packed(spark, folder, dev_num=DEV_CHUNKS)
    return chunks.select("chunk", "split", F.size("ids").cast("long").alias("n"), joined_ids("ids").alias("ids_md5"))


def _pack_capped(spark, folder):
    chunks = packed(spark, folder, dev_num=20, train_num=50)
    return chunks.select("chunk", "split", joined_ids("ids").alias("ids_md5"))


def _index(spark, folder):
    sizes = F.size(tokens.hashed_word_ids(F.col("text")))
    return packing.index_in_order(documents(spark, folder), "doc_id", sizes, itemsize=2)


def _document_index(spark, folder):
    """An empty sequence, added behind every document, ends it."""
    docs = documents(spark, folder)
    ends = docs.select((F.col("doc_id") * 2 + 1).alias("doc_id"), "lang", F.lit("").alias("text"))
    return packing.document_index(_sequences(docs.withColumn("doc_id", F.col("doc_id") * 2).select("doc_id", "lang", "text").unionByName(ends)), "ids")


def _merge(spark, folder):
    docs = documents(spark, folder)
    ids = lambda df: ordered.number_rows(df, "doc_id", "seq_id").select(
        "seq_id", "doc_id", tokens.hashed_word_ids(F.col("text")).alias("ids"))
    merged = packing.merge_token_datasets(ids(docs.where("lang = 'en'")), ids(docs.where("lang <> 'en'")))
    return merged.select("seq_id", "doc_id", F.size("ids").cast("long").alias("n"))


def _take(spark, folder):
    path = scratch(spark, "tokens")
    writers.write_token_dataset(numbered_sequences(spark, folder).withColumn("split", F.lit("train")), path)
    return packing.take_sequences(spark.read.parquet(path), 50, 400).select("seq_id", joined_ids("ids").alias("ids_md5"))


def _take_ids(spark, folder):
    wanted = documents(spark, folder).select((F.col("doc_id") * 3).alias("seq_id"))
    twice = wanted.unionByName(wanted)
    found = packing.take_ids(numbered_sequences(spark, folder), twice)
    return found.select("seq_id", joined_ids(packing.slice_ids(F.col("ids"), 2, 5)).alias("ids_md5"))


def _write_tokens(spark, folder):
    path = scratch(spark, "tokens")
    split = F.when(F.col("seq_id") < 100, "valid").otherwise("train")
    writers.write_token_dataset(numbered_sequences(spark, folder).withColumn("split", split).drop("lang"), path)
    return spark.read.parquet(path).select("seq_id", "split", F.col("size").cast("long").alias("size"), joined_ids("ids").alias("ids_md5"))


def _import_tokens(spark, folder):
    path = scratch(spark, "shards")
    writers.write_token_shards(numbered_sequences(spark, folder), path, "train", dtype_code=4, shards=3)
    found = token_files.read_token_dataset(spark, path, "train")
    return found.select("seq_id", F.size("ids").cast("long").alias("size"), joined_ids("ids").alias("ids_md5"))


def _history(spark, folder):
    rows = numbered_sequences(spark, folder).select(ordered.int_div(F.col("seq_id"), 300).alias("shard"))
    return packing.shard_history(rows, "shard")


def _lengths(spark, folder):
    rows = numbered_sequences(spark, folder).withColumnRenamed("lang", "split")
    stats = metrics.length_stats(rows, "ids")
    return stats.select("split", "rows", rounded(F.col("ids_mean")).alias("ids_mean"),
                        F.col("ids_max").cast("long").alias("ids_max"), F.col("ids_min").cast("long").alias("ids_min"))


def _mean_length(spark, folder):
    rows = numbered_sequences(spark, folder)
    every = metrics.mean_length(rows, "ids").select(F.lit("all").alias("scope"), rounded(F.col("mean_length")).alias("mean_length"))
    first = metrics.mean_length(rows, "ids", first=100, row_id="seq_id")
    return every.unionByName(first.select(F.lit("first").alias("scope"), rounded(F.col("mean_length")).alias("mean_length")))


def _throughput(spark, folder):
    # Elapsed time of the run that produced the corpus: one second per thousand characters.
    seconds = F.sum(F.length("text")) / F.lit(1000.0)
    found = metrics.throughput(documents(spark, folder), "text", seconds)
    return found.select("documents", "bytes", rounded(F.col("documents_per_s")).alias("documents_per_s"),
                        rounded(F.col("mb_per_s"), 9).alias("mb_per_s"))


def _short_count(spark, folder):
    docs = documents(spark, folder)
    n = F.col("doc_id") * F.col("doc_id") * 500
    return docs.select("doc_id", short_count(n).alias("shown"))


QUERIES = {
    "src3_read_corpus": _read_corpus,
    "src5_read_corpus_cap": _read_corpus_cap,
    "src6_read_token_dataset": _import_tokens,
    "src6_shard_history": _history,
    "src7_take_sequences": _take,
    "src7_take_ids": _take_ids,
    "snk2_write_token_dataset": _write_tokens,
    "snk3_token_index": _index,
    "snk3_document_index": _document_index,
    "snk4_merge_token_datasets": _merge,
    "snk5_write_corpus": _write_corpus,
    "prj3_escape_newlines": _escape,
    "prj4_tokenize": _tokenize,
    "prj4_tokenize_bytes": _tokenize_bytes,
    "prj4_encode_words": _encode_words,
    "prj5_build_vocab": _vocab,
    "spl1_with_row_id": _row_id,
    "pre1_prefix_sum": _prefix,
    "pak1_pack": _pack,
    "pak1_pack_capped": _pack_capped,
    "pak1_packed_lengths": flagship,
    "agg6_length_stats": _lengths,
    "agg7_mean_gen_length": _mean_length,
    "agg8_throughput": _throughput,
    "fmt_short_count": _short_count,
}

_LINE = f"regexp_replace(text, '\\n+', '{NEWLINE_SENTINEL}', 'g')"
_ONE = "regexp_replace(text, '\\n+', chr(10), 'g')"
_NUMBERED = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, text FROM documents WHERE text <> ''"

ORACLES = {
    "src3_read_corpus": f"SELECT doc_id, md5({_ONE}) AS text_md5 FROM ({_NUMBERED})",
    "src5_read_corpus_cap": f"SELECT doc_id, length({_ONE}) AS n FROM ({_NUMBERED}) WHERE doc_id < 150",
    "src6_read_token_dataset": f"WITH {SEQUENCES} SELECT seq_id, len(ids) AS size, {md5_ids('ids')} AS ids_md5 FROM seqs",
    "src6_shard_history": f"""WITH {SEQUENCES}, n AS (SELECT seq_id // 300 AS shard, count(*) AS c FROM seqs GROUP BY 1)
        SELECT shard, CAST(sum(c) OVER w - c AS BIGINT) AS start, CAST(sum(c) OVER w AS BIGINT) AS "end" FROM n WINDOW w AS (ORDER BY shard)""",
    "src7_take_sequences": f"WITH {SEQUENCES} SELECT seq_id, {md5_ids('ids')} AS ids_md5 FROM seqs WHERE seq_id >= 50 AND seq_id < 400",
    "src7_take_ids": f"""WITH {SEQUENCES} SELECT seq_id, {md5_ids('ids[3:7]')} AS ids_md5 FROM seqs
        WHERE seq_id IN (SELECT doc_id * 3 FROM documents)""",
    "snk2_write_token_dataset": f"""WITH {SEQUENCES} SELECT seq_id, CASE WHEN seq_id < 100 THEN 'valid' ELSE 'train' END AS split,
        len(ids) AS size, {md5_ids('ids')} AS ids_md5 FROM seqs""",
    "snk3_token_index": f"""WITH {SEQUENCES} SELECT seq_id, len(ids) AS size,
        CAST(coalesce(sum(len(ids) * 2) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pointer FROM seqs""",
    "snk3_document_index": f"""WITH {SEQUENCES}, ends AS (SELECT seq_id * 2 AS seq_id, len(ids) AS n FROM seqs UNION ALL SELECT seq_id * 2 + 1, 0 FROM seqs)
        SELECT seq_id + 1 AS doc_start FROM ends WHERE n = 0 UNION ALL SELECT 0""",
    "snk4_merge_token_datasets": f"""SELECT row_number() OVER (ORDER BY lang <> 'en', doc_id) - 1 AS seq_id, doc_id,
        len({HASHED_IDS}) AS n FROM documents""",
    "snk5_write_corpus": f"SELECT md5({_LINE}) AS line_md5, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1",
    "prj3_escape_newlines": f"""SELECT doc_id, md5({_LINE}) AS line_md5, md5({_ONE}) AS text_md5,
        len(regexp_extract_all(text, '\\n+')) AS breaks FROM documents""",
    "prj4_tokenize": f"""SELECT doc_id, len(ids) AS n, {md5_ids('ids')} AS ids_md5
        FROM (SELECT doc_id, list_append({HASHED_IDS}, 16777216) AS ids FROM documents)""",
    "prj4_tokenize_bytes": """SELECT doc_id, octet_length(encode(text)) AS n, md5(lower(hex(encode(text)))) AS bytes_md5 FROM documents""",
    "prj4_encode_words": f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS token, generate_subscripts({WORDS}, 1) AS pos FROM documents),
        c AS (SELECT token, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 3),
        v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM c)
        SELECT doc_id, count(*) AS n, md5(string_agg(CAST(coalesce(id, -1) AS VARCHAR), ',' ORDER BY pos)) AS ids_md5
        FROM w LEFT JOIN v USING (token) GROUP BY 1""",
    "prj5_build_vocab": f"""WITH w AS (SELECT unnest({WORDS}) AS token FROM documents),
        c AS (SELECT token, count(*) AS count FROM w GROUP BY 1 HAVING count(*) >= 2)
        SELECT token, count, row_number() OVER (ORDER BY count DESC, token) - 1 AS id FROM c""",
    "spl1_with_row_id": "SELECT doc_id, row_number() OVER (ORDER BY lang, n_chars DESC, doc_id) - 1 AS row_id FROM documents",
    "pre1_prefix_sum": """SELECT doc_id, lang,
        CAST(sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS BIGINT) AS at,
        CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) - n_chars AS BIGINT) AS at_in_lang FROM documents""",
    "pak1_pack": f"""WITH {STREAM} SELECT chunk, CASE WHEN chunk < {DEV_CHUNKS} THEN 'valid' ELSE 'train' END AS split, n, ids_md5 FROM chunks""",
    "pak1_pack_capped": f"""WITH {STREAM} SELECT chunk, CASE WHEN chunk < 20 THEN 'valid' ELSE 'train' END AS split, ids_md5 FROM chunks WHERE chunk < 70""",
    "pak1_packed_lengths": f"""WITH {STREAM} SELECT CASE WHEN chunk < {DEV_CHUNKS} THEN 'valid' ELSE 'train' END AS split,
        count(*) AS rows, round(avg(n), 6) AS ids_mean, CAST(max(n) AS INTEGER) AS ids_max, CAST(min(n) AS INTEGER) AS ids_min FROM chunks GROUP BY 1""",
    "agg6_length_stats": f"""WITH {SEQUENCES} SELECT lang AS split, count(*) AS rows, round(avg(len(ids)), 6) AS ids_mean,
        max(len(ids)) AS ids_max, min(len(ids)) AS ids_min FROM seqs GROUP BY 1""",
    "agg7_mean_gen_length": f"""WITH {SEQUENCES} SELECT 'all' AS scope, round(avg(len(ids)), 6) AS mean_length FROM seqs
        UNION ALL SELECT 'first', round(avg(len(ids)), 6) FROM seqs WHERE seq_id < 100""",
    "agg8_throughput": """SELECT count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
        round(count(*) / (sum(length(text)) / 1000.0), 6) AS documents_per_s,
        round(sum(strlen(text)) / 1048576.0 / (sum(length(text)) / 1000.0), 9) AS mb_per_s FROM documents""",
    # Half to even, in whole hundredths of the unit.
    "fmt_short_count": """WITH n AS (SELECT doc_id, doc_id * doc_id * 500 AS v FROM documents),
        u AS (SELECT doc_id, v, CASE WHEN v < 1000000 THEN 10 WHEN v < 1000000000 THEN 10000 ELSE 10000000 END AS u,
              CASE WHEN v < 1000000 THEN 'K' WHEN v < 1000000000 THEN 'M' ELSE 'B' END AS name FROM n),
        h AS (SELECT *, v // u + CASE WHEN v % u * 2 > u OR (v % u * 2 = u AND v // u % 2 = 1) THEN 1 ELSE 0 END AS h FROM u)
        SELECT doc_id, CASE WHEN v < 1000 THEN CAST(v AS VARCHAR) ELSE concat(h // 100,
          CASE WHEN h % 100 = 0 THEN '' WHEN h % 10 = 0 THEN concat('.', h % 100 // 10) ELSE concat('.', lpad(CAST(h % 100 AS VARCHAR), 2, '0')) END, name) END AS shown FROM h""",
}
