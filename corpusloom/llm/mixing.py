"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import count_words, digest_long, text_or_empty
from corpusloom.session import checkpointed

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 32
SHARD_DOCS = 1024
STRIDE = 1_000_003  # a prime, so a walk with it visits every block of a shard once


def water_fill(sources: DataFrame, size: str = "source_size", weight: str = "weight", most: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target``: the total of ``size`` shared by ``weight``, at most ``most`` times a source's own size.

    In the order of cap over weight the capped sources form a prefix, so one pass of running sums finds the
    level at which the rest shares what the capped ones leave.
    """
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(size) / F.col(weight), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: c.cast("decimal(38,0)")
    cap = wide(F.col(size) * most)
    running = (
        sources.withColumn("_t", wide(F.sum(size).over(everything)))
        .withColumn("_c", F.coalesce(F.sum(F.col(size) * most).over(before), F.lit(0)))
        .withColumn("_w", F.sum(weight).over(everything) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
        .withColumn("_capped", (F.col("_t") - wide(F.col("_c"))) * wide(F.col(weight)) > cap * wide(F.col("_w")))
    )
    spare = F.col("_t").cast("long") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col(size) * most)).over(everything), F.lit(0))
    share = F.sum(F.when(~F.col("_capped"), F.col(weight))).over(everything)
    level = spare.cast("double") * F.col(weight).cast("double") / share.cast("double")
    return running.withColumn("target", F.when(F.col("_capped"), (F.col(size) * most).cast("double")).otherwise(level)).drop("_t", "_c", "_w", "_capped")


def sainte_lague(parties: DataFrame, group: Sequence[str], votes: str, seats: str, tie: str) -> DataFrame:
    """Add ``won``: the seats of each party when ``seats`` seats of its group go to the highest quotients votes / (2s + 1).

    A divisor just above the final one gives all but a few seats at once; only the last ones, at most as many as
    the group has parties, are ranked, so the work follows the parties and not the seats.
    """
    of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, n, s = F.sum(votes).over(of).cast("double"), F.count(F.lit(1)).over(of), F.col(seats).cast("double")
    spare = s - n / 2
    sure = F.when((spare > 0) & (F.col("_total") > 0), F.floor(F.col(votes) * spare / F.col("_total") + F.lit(0.5))).otherwise(0)
    based = (
        parties.withColumn("_total", total).withColumn("_n", n)
        .withColumn("_sure", sure.cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_sure").over(of))
    )
    chances = F.when(F.col(votes) > 0, F.ceil(F.col(votes) * F.col("_n") / F.col("_total")) + 1).otherwise(0).cast("int")
    quotient = F.col(votes).cast("double") / (2 * (F.col("_sure") + F.col("_k")) + 1)
    best = of.orderBy(F.desc("_q"), F.col(tie).asc(), F.col("_k").asc())
    extra = (
        based.withColumn("_k", F.explode(F.sequence(F.lit(0), chances)))
        .where(F.col("_k") < chances)
        .withColumn("_q", quotient).withColumn("_r", F.row_number().over(best)).where("_r <= _left")
        .groupBy(*group, tie).agg(F.count("*").alias("_extra"))
    )
    keys = [*group, tie]
    return (
        based.join(extra, keys, "left")
        .withColumn("won", F.col("_sure") + F.coalesce("_extra", F.lit(0)))
        .drop("_total", "_n", "_sure", "_left", "_extra")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS,
    seed: int = 7, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, most: int = MAX_EPOCHS,
) -> DataFrame:
    """Words taken from every document: ``id, source, size, source_size, target, taken, rounds, parts``.

    ``taken = rounds * size`` and the words of ``parts``, the ranges (from inclusive, to exclusive) of its last round.

    Sources in code-point order, null last, weigh ``weights`` in turn. All words together are the budget; a source's
    target stops at ``most`` times its size. Documents are dealt to shards of a source by digest and laid end to end in
    digest order; blocks of ``block_words`` words are cut from that line and a shard's quota of blocks is walked in a
    seeded order, whole rounds first. Null and empty texts have size 0 and give nothing; repeated rows are documents of
    their own; null ids are spread by their text. An empty table gives an empty mix. Reruns agree.
    """
    source = F.col(source_col).cast("string")
    key = _key(seed, id_col, text_col)
    sized = checkpointed(docs.select(F.col(id_col).alias("_id"), source.alias("_source"), count_words(F.col(text_col)).alias("size"), key.alias("_key")))

    everything = Window.partitionBy(F.lit(0))
    ranked = everything.orderBy(F.col("_source").asc_nulls_last())
    shares = F.array(*[F.lit(w) for w in weights])
    sources = (
        sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
        .withColumn("place", F.row_number().over(ranked))
        .withColumn("weight", shares[(F.col("place") - 1) % len(weights)].cast("long"))
    )
    seats = F.round(F.sum("source_size").over(everything) / block_words).cast("long")
    quotas = sainte_lague(water_fill(sources, most=most).withColumn("seats", seats), [], "target", "seats", "place")
    quotas = checkpointed(quotas.select("_source", "place", "source_size", "target", F.col("won").alias("quota"), F.ceil(F.col("_docs") / shard_docs).alias("_shards")))

    placed = sized.join(quotas.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    shard = F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.col("_shards"))
    placed = placed.withColumn("_shard", shard)
    totals = placed.groupBy("place", "_shard").agg(F.sum("size").alias("_words"), F.max("quota").alias("quota"))
    won = sainte_lague(totals, ["place"], "_words", "quota", "_shard")
    blocks = F.ceil(F.col("_words") / block_words)
    won = won.select("place", "_shard", blocks.alias("_blocks"), F.least(F.col("won"), blocks * most).alias("_won"))

    line = Window.partitionBy("place", "_shard").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("_end", F.sum("size").over(line)).join(won, ["place", "_shard"])
    walked = laid.withColumn("rounds", F.coalesce(F.floor(F.col("_won") / F.col("_blocks")), F.lit(0)).cast("long"))
    walked = walked.withColumn("parts", _parts(seed, block_words))
    part = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return walked.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target",
        (F.col("rounds") * F.col("size") + part).alias("taken"), "rounds", "parts", "_key",
    )


def _key(seed: int, id_col: str, text_col: str) -> Column:
    """What orders a document: MD5 of seed, id and text."""
    shown = [F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("string"))]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(x, F.lit("~")) for x in shown]))


def _parts(seed: int, block: int) -> Column:
    """Word ranges of the document in the blocks that the seeded walk reaches before the quota ends."""
    first = F.col("_end") - F.col("size")
    rest = F.col("_won") - F.col("rounds") * F.col("_blocks")
    turn = digest_long(F.lit(seed), F.col("place"), F.col("_shard"))
    step = F.when(F.col("_blocks") % STRIDE == 0, F.lit(1)).otherwise(F.lit(STRIDE))
    reached = F.filter(
        F.sequence(F.floor(first / block), F.floor((F.col("_end") - 1) / block)),
        lambda b: F.pmod(b * step + turn, F.col("_blocks")) < rest,
    )
    ranges = F.transform(reached, lambda b: F.struct(
        (F.greatest(first, b * block) - first).alias("a"), (F.least(F.col("_end"), (b + 1) * block) - first).alias("b")))
    return F.when(F.col("size") > 0, ranges).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **options,
) -> DataFrame:
    """The rows that the mix trains on, in the columns of the input: whole documents once a round, then the taken parts.

    The white space behind each word stays with it. Documents of which nothing is taken give no row. Rows of equal id, text
    and source are taken as often as the mix takes them together; of those that differ elsewhere the first by a digest of the row stands for all.
    """
    mixed = mix(docs, id_col, text_col, source_col, seed=seed, **options).where("taken > 0")
    turns = mixed.groupBy("_key", F.col(source_col).alias("_source"), "rounds", "parts").agg(F.count("*").alias("_times"))
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        _key(seed, id_col, text_col).alias("_k"), F.col(source_col).cast("string").alias("_s"), whole_row.alias("_row"),
        text_or_empty(text_col).alias("_text"))
    # Equal rows share a key: one of them meets the turns of all.
    rows = rows.groupBy("_k", "_s").agg(F.min_by(F.struct("_row", "_text"), F.md5(F.to_json("_row", {"ignoreNullFields": "false"}))).alias("_d"))
    rows = turns.join(rows, (F.col("_key") == F.col("_k")) & F.col("_source").eqNullSafe(F.col("_s")))
    once = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    whole = rows.where("rounds > 0").select("_d", once(F.col("rounds") * F.col("_times"))).select("_d._row.*")
    pieces = F.regexp_extract_all("_d._text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.flatten(F.transform("parts", lambda x: F.slice("_pieces", x["a"].cast("int") + 1, (x["b"] - x["a"]).cast("int")))), "")
    cut = rows.where("size(parts) > 0").withColumn("_pieces", pieces).withColumn("_part", part).select("_d._row", "_part", once(F.col("_times")))
    cut = cut.select(*[F.col("_part").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
    return whole.unionByName(cut)
