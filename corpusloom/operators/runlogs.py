"""Run-log analytics over line tables.

Lines are ``(run_id, attempt, line_no, byte_offset, raw)``. Verdicts need the whole text of
an attempt, but only through flags, so they are maxima over lines: partially
aggregated, whatever the length of a log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.arrays import running_count
from corpusloom.functions.text import strip
from corpusloom.operators.ordered import int_div, prefix_sum, span_bucket

# --- fixed values: phrases and classes that decide a verdict, in rule order -----------
NOISE_WORDS = "warning|info"
KEEP_WORDS = (
    "error|exception|traceback|fatal|critical|oom|out of memory|nan|sigterm|signal|killed|timeout"
    "|disk|connection|assert"
)
# class: any of these groups, where a group needs all of its entries and an entry any of its phrases
RULES: list[tuple[str, list[list[tuple[str, ...]]]]] = [
    ("loss_scale", [[("loss scale",), ("minimum", "cannot decrease")]]),
    ("oom", [[("cuda out of memory",)], [("near:cuda",)]]),
    ("oom", [[("near:killed",)]]),
    ("nan", [[("word:nan",), ("loss", "gradient", "tensor")]]),
    ("disk_full", [[("no space left on device", "disk full", "file write failed", "inline_container")]]),
    ("hf", [[("huggingface.co",), ("timeout", "timed out", "rate limit")]]),
    ("net", [[("temporary failure in name resolution", "connection reset by peer")]]),
    ("import", [[("module not found", "modulenotfounderror", "importerror")]]),
    ("port", [[("address already in use", "eaddrinuse")]]),
    ("nccl", [[("nccl",), ("error", "unhandled", "abort", "timeout")]]),
    ("path", [[("filenotfounderror", "no such file or directory")]]),
    ("data", [[("jsondecodeerror",)], [("keyerror",), ("json", "data")]]),
    ("ckpt", [[("checkpoint",), ("missing", "unexpected", "size mismatch")]]),
    ("shape", [[("size mismatch", "expected size", "mat1 and mat2", "invalid shape")]]),
    ("assert", [[("assertionerror",)], [("assertion",), ("error", "failed")]]),
    ("killed", [[("sigterm", "keyboardinterrupt")]]),
    ("killed", [[("process killed",)]]),
]
NEAR_ANCHOR = "out of memory"
NEAR_DISTANCE = 500
BOILERPLATE = ("error_file", "childfailederror")
ERROR_MARKS = ("error", "traceback", "exitcode")
RANK_PREFIX = r"^\s*\[rank\d+\]\s*:?\s*"
LAST_ERRORS = 20
HARD_FAILURE_THRESHOLD = 3
TAIL_BYTES = 256 * 1024
LARGE_BYTES = 512 * 1024
REGION_STARTS = (("mid", 0.65), ("low", 0.25))
# --------------------------------------------------------------------------------------

WORD_CHAR = r"\p{L}\p{N}_"
PIECE_BITS = 22  # screen lines within one file line
REGION_SHIFT = 39  # bits of a line number
LINES_PER_BUCKET_BITS = 12
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def whole_word(text: Column, words: str) -> Column:
    """Unicode-aware whole-word search, spelled without look-around."""
    return text.rlike(rf"(^|[^{WORD_CHAR}])({words})($|[^{WORD_CHAR}])")


def _noisy(lower: Column) -> Column:
    # The plain search settles nearly every line before the expression is tried.
    mentioned = lower.contains("warning") | lower.contains("info")
    return mentioned & whole_word(lower, NOISE_WORDS)


def is_noise(raw: Column) -> Column:
    """A line that mentions warning or info and no error-level word."""
    lower = F.lower(raw)
    return _noisy(lower) & ~whole_word(lower, KEEP_WORDS)


def filter_noise(lines: DataFrame, raw: str = "raw") -> DataFrame:
    return lines.where(~is_noise(F.col(raw)))


def noise_report(lines: DataFrame, raw: str = "raw", by: tuple[str, ...] = ()) -> DataFrame:
    """Lines dropped, lines rescued by an error word, and lines without a noise word."""
    lower = F.lower(F.col(raw))
    kind = F.when(~_noisy(lower), "plain").when(whole_word(lower, KEEP_WORDS), "rescued").otherwise("dropped")
    counted = lines.select(*by, kind.alias("kind")).groupBy(*by)
    return counted.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("dropped", "rescued", "plain")])


def near(text: Column, a: str, b: str, distance: int = NEAR_DISTANCE) -> Column:
    """Do two phrases start within ``distance`` characters of each other in one text?"""
    quote = lambda s: r"\Q" + s + r"\E"

    def ordered(x: str, y: str) -> Column:
        # Starts at most ``distance`` apart; the look-ahead lets the phrases overlap.
        return text.rlike(rf"(?s)(?={quote(x)}).{{0,{distance}}}?(?={quote(y)})")

    return ordered(a, b) | ordered(b, a)


def _starts(text: Column, phrase: str) -> Column:
    """0-based start of every non-overlapping occurrence, linear in the text."""
    parts = F.split(text, r"\Q" + phrase + r"\E", -1)
    ends = running_count(F.transform(parts, lambda p: F.length(p)))
    return F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda at, i: at + i * len(phrase))


def near_in_log(
    lines: DataFrame, keys: list[str], order: str, raw: str, anchor: str, others: list[str],
    distance: int = NEAR_DISTANCE,
) -> DataFrame:
    """Per log, whether each phrase of ``others`` starts within ``distance`` of ``anchor``.

    Positions count the characters of the kept lines joined by line breaks. They come from a
    bucketed prefix sum; matches fall into cells as wide as the distance, each cell keeps
    only its outermost positions, and only neighbouring cells are compared. Nothing
    is paired and no log is gathered.
    """
    phrases = [anchor, *others]
    present = F.lit(False)
    for phrase in phrases:
        present = present | F.col(raw).contains(phrase)
    # Only the lengths of the other lines matter, so their text is not shuffled.
    slim = lines.select(*keys, order, F.length(raw).cast("long").alias("_n"), F.when(present, F.col(raw)).alias("_text"))
    where = span_bucket(order, PIECE_BITS + LINES_PER_BUCKET_BITS)
    placed = prefix_sum(slim, order, F.col("_n") + 1, "_at", by=keys, bucket=where, levels=2)

    def occurrences(kind: int) -> Column:
        entry = lambda i: F.struct(F.lit(kind).alias("kind"), (i + F.col("_at")).alias("pos"))
        return F.transform(_starts(F.col("_text"), phrases[kind]), entry)

    matches = placed.where(F.col("_text").isNotNull())
    found = F.concat(*[occurrences(k) for k in range(len(phrases))])
    hits = matches.select(*keys, F.explode(found).alias("h")).select(*keys, "h.*")
    width = distance + 1
    cells = hits.withColumn("_cell", int_div(F.col("pos"), width))
    # A cell also reports to its right neighbour, which then sees both.
    spread = cells.withColumn("_home", F.explode(F.array(F.col("_cell"), F.col("_cell") + 1)))
    own = F.col("_home") == F.col("_cell")
    stats = []
    for kind in range(len(others) + 1):
        here, before = own & (F.col("kind") == kind), ~own & (F.col("kind") == kind)
        stats += [F.min(F.when(here, F.col("pos"))).alias(f"_lo{kind}"),
                  F.max(F.when(before, F.col("pos"))).alias(f"_hi{kind}")]
    per_cell = spread.groupBy(*keys, "_home").agg(*stats)
    flags = []
    for kind, phrase in enumerate(others, start=1):
        same = F.col("_lo0").isNotNull() & F.col(f"_lo{kind}").isNotNull()
        left = F.col(f"_lo{kind}") - F.col("_hi0") <= distance
        right = F.col("_lo0") - F.col(f"_hi{kind}") <= distance
        met = same | F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))
        flags.append(F.max(met).alias(f"near:{phrase}"))
    return per_cell.groupBy(*keys).agg(*flags)


def log_regions(lines: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Byte windows of each log: the last 256 KB and, above 512 KB, the same from 65 % and 25 %.

    Adds ``region`` (0 tail, 1 mid, 2 low) and ``bytes``, how many of the line's bytes lie in the window. Windows
    may overlap, so a line may appear twice, and a line across an edge is cut there; a character cut in
    two becomes a replacement character, whose own bytes are not those of the log.
    """
    size = F.octet_length(raw).cast("long")
    ends = lines.groupBy(*keys).agg(F.max(F.col("byte_offset") + size + 1).alias("_total"))
    joined = lines.join(ends.withColumnsRenamed({k: f"_r_{k}" for k in keys}),
                        [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    total = F.col("_total")
    window = lambda i, start: F.struct(
        F.lit(i).alias("region"), start.alias("lo"), F.least(start + TAIL_BYTES, total).alias("hi")
    )
    tail = window(0, F.greatest(total - TAIL_BYTES, F.lit(0).cast("long")))
    extra = [window(i, F.floor(total * share)) for i, (_, share) in enumerate(REGION_STARTS, start=1)]
    windows = F.when(total > LARGE_BYTES, F.array(tail, *extra)).otherwise(F.array(tail))
    begin, end = F.col("byte_offset"), F.col("byte_offset") + size
    touching = F.filter(windows, lambda w: (begin < w["hi"]) & (end >= w["lo"]))
    cut = joined.withColumn("_w", F.explode(touching))
    lo = F.greatest(F.col("_w.lo") - begin, F.lit(0))
    hi = F.least(F.col("_w.hi") - begin, size)
    part = F.make_valid_utf8(F.substring(F.encode(F.col(raw), "UTF-8"), (lo + 1).cast("int"), (hi - lo).cast("int")).cast("string"))
    whole = (lo == 0) & (hi == size)
    return cut.select(
        *[c for c in lines.columns if c != raw],
        F.when(whole, F.col(raw)).otherwise(part).alias(raw),
        F.col("_w.region").alias("region"),
        (hi - lo).alias("bytes"),
    )


def classification_lines(
    lines: DataFrame, keys: list[str], raw: str = "raw", order: str = "line_no", mode: str = "full"
) -> DataFrame:
    """What a verdict looks at: ``(keys, _order, text)``, lower-cased, text null on noise lines.

    ``mode='sampled'`` looks at the byte windows, in the order tail, mid, low; ``'full'`` at
    the whole log in file order.
    """
    if mode == "sampled":
        seen = log_regions(lines, keys, raw).withColumn(
            "_order", F.shiftleft(F.col("region").cast("long"), REGION_SHIFT) + F.col(order)
        )
    elif mode == "full":
        seen = lines.withColumn("_order", F.col(order).cast("long"))
    else:
        raise ValueError(f"mode must be 'full' or 'sampled', not {mode!r}")
    # Progress bars leave several screen lines in one file line.
    parts = F.split(F.col(raw), LINE_ENDS)
    pieces = seen.select(*keys, "_order", F.posexplode(parts).alias("_i", "text"))
    place = F.shiftleft("_order", PIECE_BITS) + F.col("_i")
    kept = F.when(~is_noise(F.col("text")), F.lower("text"))
    return pieces.select(*keys, place.alias("_order"), kept.alias("text"))


def _phrases() -> list[str]:
    """Every phrase a rule asks for; its place in the list is its bit in the mask."""
    named = {p for _, groups in RULES for group in groups for entry in group for p in entry}
    return sorted(named | {NEAR_ANCHOR, "cuda", "killed"})


def _bit(phrase: str) -> int:
    return 1 << _phrases().index(phrase)


def near_bit(phrase: str) -> int:
    """Bit of a phrase that starts near the anchor."""
    return _bit(f"near:{phrase}")


def phrase_mask(text: str) -> Column:
    """Phrases found in one line as the bits of a long; ``bit_or`` combines lines.

    One mergeable column per attempt, over tasks and over micro-batches alike. Proximity
    bits are left open.
    """
    tests = []
    for phrase in _phrases():
        if phrase.startswith("near:"):
            continue
        if phrase.startswith("word:"):
            found = f"{text} RLIKE r'(^|[^{WORD_CHAR}]){phrase[5:]}($|[^{WORD_CHAR}])'"
        else:
            found = f"contains({text}, '{phrase}')"
        tests.append(f"IF({found}, {_bit(phrase)}L, 0L)")
    return F.expr(" | ".join(tests))


def verdict(mask: str) -> Column:
    """First rule whose phrases are all in the mask, else ``other``."""

    def any_of(phrases: tuple[str, ...]) -> str:
        return f"({mask} & {sum(_bit(p) for p in phrases)}L) <> 0"

    whens = []
    for name, groups in RULES:
        test = " OR ".join("(" + " AND ".join(any_of(entry) for entry in group) + ")" for group in groups)
        whens.append(f"WHEN {test} THEN '{name}'")
    return F.expr(f"CASE {' '.join(whens)} ELSE 'other' END")


def classify_failures(
    lines: DataFrame, keys: list[str], raw: str = "raw", order: str = "line_no", mode: str = "full"
) -> DataFrame:
    """Failure class of each attempt: the first matching rule, else ``other``."""
    cleaned = classification_lines(lines, keys, raw, order, mode)
    # A null text sets no bit, so an attempt of noise alone keeps its row.
    flags = cleaned.groupBy(*keys).agg(F.bit_or(phrase_mask("text")).alias("mask"))
    # Positions are worked out only where they can change the verdict.
    has = lambda *ps: F.col("mask").bitwiseAND(F.lit(sum(_bit(p) for p in ps))) != 0
    unsettled = flags.where(has(NEAR_ANCHOR) & has("cuda", "killed") & ~has("cuda out of memory"))
    suspects = unsettled.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    kept = cleaned.where(F.col("text").isNotNull()).join(suspects, same, "left_semi")
    close = near_in_log(kept, keys, "_order", "text", NEAR_ANCHOR, ["cuda", "killed"])
    placed = close.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        sum((F.when(F.col(f"`near:{p}`"), F.lit(near_bit(p))).otherwise(0) for p in ("cuda", "killed")), F.lit(0)).alias("_near"),
    )
    known = flags.join(placed, same, "left").withColumn("mask", F.col("mask").bitwiseOR(F.coalesce("_near", F.lit(0))))
    return known.select(*keys, verdict("mask").alias("reason"))


def outcome_reason(exit_code: Column, classified: Column) -> Column:
    """The exit code decides first; the log only for ordinary failures."""
    return (
        F.when(exit_code == 0, "success")
        .when(exit_code == 130, "interrupted")
        .when(exit_code == 124, "timeout")
        .when(exit_code < 0, "killed")
        .otherwise(classified)
    )


def error_fingerprint(
    lines: DataFrame, keys: list[str], raw: str = "raw", order: str = "line_no", mode: str = "full"
) -> DataFrame:
    """MD5 of the last 20 error lines of each attempt, rank prefixes and boilerplate removed.

    The rank limit is applied in each task before the shuffle, so a huge log sends at most
    20 lines per task.
    """
    text = F.col("text")
    is_error = F.lit(False)
    for mark in ERROR_MARKS:
        is_error = is_error | text.contains(mark)
    for mark in BOILERPLATE:
        is_error = is_error & ~text.contains(mark)
    # A null text is no error.
    errors = classification_lines(lines, keys, raw, order, mode).where(is_error)
    errors = errors.withColumn("text", F.regexp_replace(strip(text), RANK_PREFIX, ""))
    latest = Window.partitionBy(*keys).orderBy(F.desc("_order"))
    last = errors.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= LAST_ERRORS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_order", "text"))), lambda x: x["text"]), "\n")
    return last.groupBy(*keys).agg(F.md5(joined).alias("error_hash"), F.count(F.lit(1)).alias("error_lines"))


# --- log line formats -----------------------------------------------------------------


def _number(raw: Column, label: str) -> Column:
    return F.regexp_extract(raw, rf"{label}\s*([-+0-9.eE]+|nan|inf)", 1)


def parse_train_log(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Typed columns of training, evaluation, benchmark, policy and generation lines.

    Lines of no known format are dropped. Keys of one ``key: value`` segment follow the
    published layouts, two of which write a key without a colon.
    """
    text = F.col(raw)
    kind = (
        F.when(text.rlike(r"^train \| epoch"), "train")
        .when(text.rlike(r"^train \| data_epochs"), "policy_train")
        .when(text.rlike(r"^eval \|"), "policy_eval")
        .when(text.rlike(r"^gen \| avg\. lens:"), "generation")
        .when(text.rlike(r"^\S+ \| name: "), "benchmark")
        .when(text.rlike(r"^\S+ \| avg_loss: "), "evaluation")
    )
    pairs = F.str_to_map(F.concat(F.lit("_:"), text), F.lit(r"\s*\|\s*"), F.lit(r":\s*"))
    staged = lines.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn("_m", pairs)
    item = lambda k: F.trim(F.try_element_at("_m", F.lit(k)))
    number = lambda k: item(k).try_cast("double")
    of = lambda k, i: F.split_part(item(k), F.lit("/"), F.lit(i)).try_cast("long")
    fragment = lambda name: extract_metric(text, name)
    return staged.select(
        *lines.columns,
        "kind",
        F.regexp_extract(text, r"^(\S+) \|", 1).alias("split"),
        _number(text, r"\| epoch").try_cast("long").alias("epoch"),
        _number(text, r"\| data_epochs").try_cast("long").alias("data_epoch"),
        of("global iter", 1).alias("global_step"),
        of("global iter", 2).alias("total_steps"),
        F.coalesce(of("Iter", 1), of("inner iter", 1)).alias("iter"),
        F.coalesce(number("loss"), number("tot_loss")).alias("loss"),
        number("ds_loss").alias("ds_loss"),
        number("avg_loss").alias("avg_loss"),
        number("lr").alias("lr"),
        number("scale").alias("scale"),
        number("step time").alias("step_time"),
        number("threshold").alias("threshold"),
        number("reward").alias("reward"),
        number("rev_kl").alias("rev_kl"),
        F.coalesce(number("lm_loss"), _number(text, r"\| lm_loss").try_cast("double")).alias("lm_loss"),
        item("name").alias("name"),
        F.coalesce(fragment("rougeL"), number("rougeL")).alias("rougeL"),
        F.coalesce(fragment("exact_match"), number("exact_match")).alias("exact_match"),
        F.coalesce(number("avg. gen lenth"), number("avg. lens")).alias("mean_length"),
    )


def extract_metric(raw: Column, name: str) -> Column:
    """Number of ``'name': x`` inside a printed dictionary."""
    return F.regexp_extract(raw, rf"'{name}': ([0-9.]+)", 1).try_cast("double")


MARKER = r"^==== (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (COMMAND:|START|TIMEOUT|INTERRUPT)"


def attempt_markers(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Marker lines: time stamp and kind (``start``, ``timeout``, ``interrupt``)."""
    word = F.regexp_extract(raw, MARKER, 2)
    kind = (
        F.when(word.isin("COMMAND:", "START"), "start").when(word == "TIMEOUT", "timeout").when(word == "INTERRUPT", "interrupt")
    )
    marked = lines.withColumn("marker", kind).where(F.col("marker").isNotNull())
    return marked.withColumn("marked_at", F.try_to_timestamp(F.regexp_extract(raw, MARKER, 1), F.lit("yyyy-MM-dd HH:mm:ss")))
