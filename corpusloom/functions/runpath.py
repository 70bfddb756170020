"""Hyper-parameters written into, and read back from, run directory names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("eval", "lm", "kd", "gen", "policy")
FLOAT = r"[0-9.]+(?:e[-+]?\d+)?"
# The marker before each value in a directory name, and the value's type.
TRAIN_MARKS = (
    ("epochs", r"(?:^|[/-])e(\d+)-bs", "int"),
    ("batch_size", r"(?:^|[/-])bs(\d+)", "int"),
    ("lr", rf"-lr({FLOAT})", "double"),
    ("accumulation", r"-G(\d+)", "int"),
    ("gpus", r"-N(\d+)", "int"),
    ("nodes", r"-NN(\d+)", "int"),
    ("kd_ratio", rf"-kd({FLOAT})", "double"),
    ("lm_coef", rf"-lm({FLOAT})", "double"),
    ("max_length", r"-len(\d+)", "int"),
    ("model_parallel", r"-mp(\d+)", "int"),
    ("lora_r", r"-lora-(\d+)-", "int"),
    ("lora_alpha", r"-lora-\d+-(\d+)-", "int"),
    ("lora_dropout", rf"-lora-\d+-\d+-({FLOAT})", "double"),
    ("ppo_epochs", r"/pe(\d+)", "int"),
    ("reward_scaling", rf"_rs({FLOAT})", "double"),
    ("num_rollouts", r"_nr(\d+)", "int"),
    ("teacher_mix", rf"_tm({FLOAT})", "double"),
)


def _present(c: Column) -> Column:
    return c.isNotNull()


def _mark(prefix: str, c: Column) -> Column:
    """``prefix`` and the value, or nothing when the value is null."""
    return F.when(_present(c), F.concat(F.lit(prefix), c.cast("string"))).otherwise(F.lit(""))


def _flag(text: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit(text)).otherwise(F.lit(""))


def eval_checkpoint(name: Column) -> Column:
    """Slashes become ``_`` except before a numeric last part."""
    numeric = name.rlike(r"/\d+\z")
    head = F.regexp_replace(name, r"/\d+\z", "")
    step = F.regexp_extract(name, r"/(\d+)\z", 1)
    flat = F.replace(head, F.lit("/"), F.lit("_"))
    return F.when(numeric, F.concat(flat, F.lit("/"), step)).otherwise(F.replace(name, F.lit("/"), F.lit("_")))


def run_path(kind: str, c: dict[str, Column]) -> Column:
    """Directory of a run. ``c`` maps parameter names to columns; a missing name means unset.

    With no adapter the training kinds leave the checkpoint name out, as published runs do.
    Learning rates and other floats are taken as text, in the spelling to be shown.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown run kind {kind!r}")
    null = F.lit(None).cast("string")
    get = lambda n: c.get(n, null)
    root = get("save")
    join = lambda *parts: F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts])
    if kind == "eval":
        name = F.coalesce(get("peft_name"), get("ckpt_name"))
        data = F.concat(get("data_names"), F.lit("-"), get("max_length").cast("string"), _mark("-mp", get("model_parallel")))
        return join(root, data, eval_checkpoint(name), get("seed").cast("string"))
    if kind == "gen":
        leaf = F.concat(F.lit("t"), get("temperature").cast("string"), F.lit("-l"), get("max_length").cast("string"))
        return join(root, get("ckpt_name"), leaf)
    adapter = F.when(_present(get("peft_name")), F.concat_ws("-", get("ckpt_name"), get("peft_name"))).otherwise(F.lit(""))
    if kind in ("kd", "policy"):
        teacher = F.when(
            _present(get("teacher_peft_name")),
            F.concat(F.lit("-"), get("teacher_ckpt_name"), F.lit("-"), get("teacher_peft_name")),
        ).otherwise(F.lit(""))
        adapter = F.when(_present(get("peft_name")), adapter).otherwise(teacher)
    lora = F.when(
        _present(get("lora_r")),
        F.concat(F.lit("-lora-"), F.concat_ws("-", *[get(n).cast("string") for n in ("lora_r", "lora_alpha", "lora_dropout")])),
    ).otherwise(F.lit(""))
    shared = F.concat(
        F.lit("bs"), get("batch_size").cast("string"), F.lit("-lr"), get("lr").cast("string"),
        F.lit("-G"), get("accumulation").cast("string"), F.lit("-N"), get("gpus").cast("string"),
        F.lit("-NN"), get("nodes").cast("string"),
    )
    parallel = _mark("-mp", get("model_parallel"))
    suffix = F.coalesce(get("suffix"), F.lit(""))
    if kind == "policy":
        leaf = F.concat(shared, _mark("-lm", get("lm_coef")), _mark("-len", get("max_length")), parallel, lora)
        ppo = F.concat(
            _mark("pe", get("ppo_epochs")), _mark("_rs", get("reward_scaling")), _mark("_nr", get("num_rollouts")),
            _flag("_ln", c.get("length_norm", F.lit(False))), _flag("_sr", c.get("single_step_reg", F.lit(False))),
            _mark("_tm", get("teacher_mix")), suffix,
        )
        return join(root, adapter, leaf, ppo)
    ratio = _mark("-kd", get("kd_ratio")) if kind == "kd" else F.lit("")
    leaf = F.concat(_mark("e", get("epochs")), F.lit("-"), shared, ratio, parallel, lora, suffix)
    return join(root, adapter, leaf)


def parse_run_path(path: Column) -> Column:
    """Struct of the parameters found in a run path, null where absent."""
    def value(pattern: str, kind: str) -> Column:
        return F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).try_cast(kind)

    fields = [value(pattern, kind).alias(name) for name, pattern, kind in TRAIN_MARKS]
    eval_shape = r"(?:^|/)([^/]+)-(\d+)(?:-mp\d+)?/([^/]+(?:/\d+)?)/(\d+)\z"
    gen_shape = rf"/t({FLOAT})-l(\d+)\z"
    is_train = path.rlike(r"bs\d+-lr")
    extra = lambda shape, i, kind: F.when(
        ~is_train, F.nullif(F.regexp_extract(path, shape, i), F.lit("")).try_cast(kind)
    )
    return F.struct(
        *fields,
        F.regexp_like(path, F.lit(r"_ln(_|\z)")).alias("length_norm"),
        F.regexp_like(path, F.lit(r"_sr(_|\z)")).alias("single_step_reg"),
        extra(eval_shape, 1, "string").alias("data_names"),
        extra(eval_shape, 2, "int").alias("eval_max_length"),
        extra(eval_shape, 3, "string").alias("checkpoint"),
        extra(eval_shape, 4, "int").alias("seed"),
        extra(gen_shape, 1, "double").alias("temperature"),
        extra(gen_shape, 2, "int").alias("gen_max_length"),
    )
