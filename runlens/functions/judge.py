"""Judge side: prompt rendering and reply parsing.

* ``render_template`` splits a ``str.format`` template on the driver (the
  template is configuration) and builds one ``concat`` of literals and
  columns, so a placeholder-looking text inside a column value stays as it
  is -- chained ``replace`` calls would substitute into it.
* ``parse_judge_replies`` takes the greedy ``{...}`` span of the reply (or the
  whole reply when there is none), parses it strictly and reads the six
  scores.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.functions.jsontext import let
from runlens.functions.text import outer_span

# A compact judge template with the ten placeholders the experiment's
# evaluation prompts use (scene files carry the full rubric; see
# ``sources.config.scenes_from_files``).
DEFAULT_JUDGE_TEMPLATE = (
    "Input prompt:\n{input_prompt}\n\nModel output:\n{output_content}\n\n"
    "Format checks:\n"
    "1. JSON valid: {json_valid} ({json_valid_detail})\n"
    "2. Structure: {structure_valid} ({structure_detail})\n"
    "3. Field names: {field_names_valid} ({field_names_detail})\n"
    "4. Data types: {data_types_valid} ({data_types_detail})\n\n"
    "Reply with JSON only: {{\"score\": number, \"note\": \"text\"}}"
)
TEMPLATE_FIELDS = ["input_prompt", "output_content", "json_valid", "json_valid_detail",
                   "structure_valid", "structure_detail", "field_names_valid", "field_names_detail",
                   "data_types_valid", "data_types_detail"]


def python_bool_text(c: Column) -> Column:
    """How Python prints a boolean: ``True`` / ``False`` (``None`` for NULL)."""
    return F.when(c, F.lit("True")).when(~c, F.lit("False")).otherwise(F.lit("None"))


def render_template(template: str, values: dict[str, Column]) -> Column:
    """``template.format(**values)`` as one ``concat``.

    Format specs and conversions are not supported (the templates use none).
    """
    parts = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if spec or conv:
                raise ValueError("format specs are not supported")
            if field not in values:
                raise KeyError(field)
            parts.append(values[field].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def judge_prompt(template: str, input_prompt: Column, output: Column, checks: dict[str, Column]) -> Column:
    """T17 with the experiment's placeholders; booleans print as Python does."""
    vals = {"input_prompt": input_prompt, "output_content": output}
    for k, c in checks.items():
        vals[k] = python_bool_text(c) if k.endswith("_valid") else c
    return render_template(template, vals)


def judge_prompts(scene: str, templates: dict[str, str], input_prompt: Column, output: Column, checks: dict[str, Column]) -> Column:
    """T17 over runs of several scenes: each run's prompt from the template of
    its scene (NULL for a scene without one).

    Templates are split once, here.  Where all name the same fields in the same
    order -- the rubrics of one experiment do -- the prompt is one ``concat``
    whose literal pieces are looked up by scene.
    """
    split = {name: list(string.Formatter().parse(template)) for name, template in templates.items()}
    shapes = {tuple(field for _, field, _, _ in parts) for parts in split.values()}
    if len(shapes) != 1 or any(spec or conv for parts in split.values() for _, field, spec, conv in parts if field is not None):
        text = F.lit(None).cast("string")
        for name, template in templates.items():
            text = F.when(F.col(scene) == name, judge_prompt(template, input_prompt, output, checks)).otherwise(text)
        return text
    values = {"input_prompt": input_prompt, "output_content": output}
    values |= {k: python_bool_text(c) if k.endswith("_valid") else c for k, c in checks.items()}
    pieces = F.create_map(*[x for name, parts in split.items() for x in (F.lit(name), F.array(*[F.lit(p[0]) for p in parts]))])

    def filled(own: Column) -> Column:
        out = []
        for i, field in enumerate(next(iter(shapes))):
            out.append(own[i])
            if field is not None:
                out.append(values[field].cast("string"))
        return F.concat(*out)

    return let(F.try_element_at(pieces, F.col(scene)), filled)


def _score(members: Column, key: str) -> Column:
    """struct(score, readable) of one dimension among a parsed reply's members.

    An absent score is 0, a present JSON null is NULL (means skip it), a
    finite number or numeric string is itself; anything else (text, NaN,
    Infinity, an array, an object) is 0 and not readable.
    """
    value = F.try_element_at(members, F.lit(key))
    number = F.try_variant_get(value, "$", "string").try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return (F.when(value.isNull(), F.struct(F.lit(0.0).alias("score"), F.lit(True).alias("readable")))
            .when(F.is_variant_null(value), F.struct(F.lit(None).cast("double").alias("score"), F.lit(True).alias("readable")))
            .when(finite, F.struct(number.alias("score"), F.lit(True).alias("readable")))
            .otherwise(F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("readable"))))


def parse_judge_replies(df, reply: str = "reply", out: str = "judge"):
    """T18 over a DataFrame: adds struct column ``out`` (judge_ok, six scores,
    scores_readable, score_note) from the greedy ``{...}`` span of the reply,
    or the whole reply when there is none.

    A reply whose root is no object is a failed judge call.  Staged: the span
    is found once and parsed once.
    """
    from runlens.functions.jsoncheck import document_of

    r = F.col(reply)
    s1 = df.select("*", outer_span(r, "{", "}").alias("__jspan"))
    s2 = s1.select("*", F.when(F.col("__jspan") != "", F.col("__jspan")).otherwise(r).alias("__jtext"))
    s3 = document_of(s2, "__jtext", "__jdoc", "__jvalid")
    is_object = F.col("__jvalid") & F.ltrim(F.translate("__jtext", "\t\r\n", "   ")).startswith("{")
    s4 = s3.select("*", F.coalesce(is_object, F.lit(False)).alias("__jok"))
    # the members of the object, read by one cast
    s5 = s4.select("*", F.when(F.col("__jok"), F.try_variant_get("__jdoc", "$", "map<string,variant>")).alias("__jobj"))
    s6 = s5.select("*", *[_score(F.col("__jobj"), key).alias(f"__j_{col}") for col, key, _ in S.DIMENSIONS])
    readable = F.col("__jok")
    for col, _, _ in S.DIMENSIONS:
        readable = readable & F.col(f"__j_{col}.readable")
    fields = [F.col("__jok").alias("judge_ok"), *[F.col(f"__j_{col}.score").alias(col) for col, _, _ in S.DIMENSIONS],
              readable.alias("scores_readable"), F.try_variant_get(F.try_element_at("__jobj", F.lit(S.SCORE_NOTE_KEY)), "$", "string").alias("score_note")]
    return s6.select(*df.columns, F.struct(*fields).alias(out))
