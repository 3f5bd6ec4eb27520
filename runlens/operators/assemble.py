"""J7 + F7-F9: one run row from the generation result and the judge reply.

``outputs`` and ``judgements`` are both one row per run; they meet in an
equi-join on ``run_seq`` (unique, so no skew).  Failed generations keep
their row with zero scores; a run the judge could not score keeps
``success = true`` with zeros, as the experiment records it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.functions.jsoncheck import normalize_columns
from runlens.functions.judge import parse_judge_replies

#: What a failed run records: zeros, and no sampling parameters.
FAILED_ZERO = ["input_tokens", "output_tokens", "elapsed_time"]
FAILED_ABSENT = ["temperature", "top_p"]
FAILED_ABSENT_ORTHOGONAL = ["top_p", *FAILED_ZERO]


def failed_row_defaults(runs: DataFrame, orthogonal: bool = False) -> DataFrame:
    """F8: failed rows as the experiment records them -- zero scores; the
    exploratory record has zero tokens and time and no sampling parameters,
    the orthogonal one keeps its temperature and has no tokens and time."""
    zero = S.DIM_COLS + ([] if orthogonal else FAILED_ZERO)
    absent = FAILED_ABSENT_ORTHOGONAL if orthogonal else FAILED_ABSENT
    types = dict(runs.dtypes)
    cols = {c: F.when(F.col("success"), F.col(c)).otherwise(F.lit(0).cast(types[c])) for c in zero if c in types}
    cols |= {c: F.when(F.col("success"), F.col(c)) for c in absent if c in types}
    return runs.select(*[cols.get(c, F.col(c)).alias(c) for c in runs.columns])


def assemble_runs(outputs: DataFrame, judgements: DataFrame, key: str = "run_seq", orthogonal: bool = False) -> DataFrame:
    """outputs(key, success, output_content, ...) + judgements(key, reply)
    -> run rows with ``json_valid``, ``judge_ok``, the six scores and note.

    The orthogonal record keeps the raw output text and has no ``json_valid``.
    Inputs bucketed by the key join without an exchange.
    """
    # parse each side where it is read, then join the parsed rows on the unique key
    parsed = parse_judge_replies(judgements.select(key, "reply"), "reply", "__j").drop("reply")
    ok = F.col("success")
    cols = [c for c in outputs.columns if c != "output_content"]
    if orthogonal:
        sides = outputs.select(*cols, F.when(ok, F.col("output_content")).alias("output_content"))
        texts = ["output_content"]
    else:
        sides = normalize_columns(outputs, "output_content").select(
            *cols, F.when(ok, F.col("normalized")).otherwise(F.lit("")).alias("output_content"),
            F.when(ok, F.col("json_valid")).alias("json_valid"))
        texts = ["output_content", "json_valid"]
    j = sides.join(parsed, key, "left")
    # a score is 0 without a judgement; NULL only where the judge wrote null
    judged = F.coalesce(F.col("__j.judge_ok"), F.lit(False))
    out = j.select(
        *cols, *texts,
        F.when(ok, judged).alias("judge_ok"),
        *[F.when(ok & judged, F.col(f"__j.{d}")).otherwise(F.lit(0.0)).alias(d) for d in S.DIM_COLS],
        F.when(ok & judged, F.col("__j.scores_readable")).alias("scores_readable"),
        F.when(ok, F.col("__j.score_note")).alias("score_note"),
    )
    return failed_row_defaults(out, orthogonal)


def with_prompts(runs: DataFrame, scheme_prompts: DataFrame) -> DataFrame:
    """J6 + T15 + T16: attach each run's prompt (system + user text of its
    scene and scheme), the prompt text as sent and the message list.

    ``scheme_prompts(scene_id, scheme_key, system, user, ...)`` is a
    configuration table (one row per scene and scheme); Spark broadcasts it
    below its size threshold.
    """
    from runlens.functions.text import chat_messages, prompt_text
    from runlens.sources.config import join_dimension

    p = scheme_prompts.select("scene_id", "scheme_key", "system", "user")
    j = join_dimension(runs, p, ["scene_id", "scheme_key"], "left")
    return (j.withColumn("input_prompt", prompt_text("system", "user"))
            .withColumn("messages", chat_messages("system", "user"))
            .drop("system", "user"))
