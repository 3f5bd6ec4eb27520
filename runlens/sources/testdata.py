"""Run-table relations derived from the driver's benchmark tables.

The experiment's own result data is not published, so the test and bench
inputs are derived deterministically from ``events`` (one event = one run):
scene from the event type, model and scheme from the user, parameter set and
orthogonal group from the event id, six integer scores from fixed modular
formulas, failures every 97th event.  ``outputs`` and ``judge_replies``
render a model output and a judge reply per run from the same columns, with
the shapes the checks must tell apart (fenced, wrapped, bare array, missing
field, wrong type, truncated, no JSON, ...).

Every derivation is a *portable SQL expression* kept in one list, used here
through ``selectExpr`` and by the DuckDB oracle in ``__spark_entry__`` -- the
two engines see the same input by construction.  The work grows linearly
with ``events``; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens import schemas as S
from runlens.functions import judge as JG
from runlens.operators.assemble import failed_row_defaults
from runlens.operators.balance import spread_files
from runlens.sources import config as C

NL = "\n"
IDEOGRAPHIC_SPACE = "　"

# (name, portable SQL expression over events) -- the run columns.
RUN_BASE = [
    ("run_seq", "event_id"),
    ("scene_id", "CASE WHEN event_type IN ('view', 'click') THEN 'sceneA' "
                 "WHEN event_type = 'purchase' THEN 'sceneB' ELSE 'sceneC' END"),
    ("model_key", "CASE WHEN user_id % 2 = 0 THEN 'qwen14b' ELSE 'qwen32b' END"),
    ("scheme_key", "concat('scheme', CAST(1 + user_id % 3 AS STRING))"),
    ("param_set", "concat('P', CAST(1 + event_id % 12 AS STRING))"),
    ("group_id", "concat('group', CAST(1 + event_id % 4 AS STRING))"),
    # P1 runs of the sensitivity scene and scheme belong to both designs by turns
    ("design", "CASE WHEN event_id % 12 <> 0 OR (event_type IN ('view', 'click') AND user_id % 3 = 0 "
               "AND CAST(floor(event_id / 12) AS BIGINT) % 2 = 1) THEN 'sens' ELSE 'main' END"),
    ("success", "event_id % 97 <> 0"),
    ("a1", "(event_id * 37) % 101"),
    ("a2", "(event_id * 53 + 7) % 101"),
    ("a3", "(event_id * 71 + 3) % 101"),
    ("a4", "(event_id * 13 + 11) % 101"),
    ("a5", "(event_id * 29 + 5) % 101"),
    ("a6", "(event_id * 91 + 2) % 101"),
    ("tok_in", "100 + user_id"),
    ("tok_out", "CAST(floor(value) AS BIGINT)"),
    ("secs", "value"),
]

# Final run columns over the base + dimension columns.
RUN_FINAL = [
    ("run_seq", "run_seq"),
    ("group_id", "group_id"),
    ("design", "design"),
    ("scene_id", "scene_id"),
    ("scene_name", "scene_name"),
    ("scheme_key", "scheme_key"),
    ("scheme", "scheme"),
    ("model_key", "model_key"),
    ("model", "model"),
    ("param_set", "param_set"),
    ("temperature", "temperature"),
    ("top_p", "top_p"),
    ("success", "success"),
    ("error", "CASE WHEN success THEN NULL ELSE 'generation failed' END"),
    *[(c, f"CAST(CASE WHEN success THEN a{i + 1} END AS DOUBLE)") for i, c in enumerate(S.DIM_COLS)],
    ("input_tokens", "CASE WHEN success THEN tok_in END"),
    ("output_tokens", "CASE WHEN success THEN tok_out END"),
    ("elapsed_time", "CASE WHEN success THEN secs END"),
]


def _items_sql() -> dict:
    addr = ("CASE event_id % 7 WHEN 0 THEN '0x0000' WHEN 1 THEN '0x0002' "
            "WHEN 2 THEN '0x0104' WHEN 3 THEN '0x000E' WHEN 4 THEN '0x0200' "
            "WHEN 5 THEN '0xEB90' ELSE '0x0F0F' END")
    n_m = "(user_id % 3)"
    n_c = "((user_id + event_id) % 3)"

    def arr(word, n):
        return f"'[', repeat('\"{word}\",', {n}), '\"{word}\"]'"

    def item(i, criteria=True):
        parts = [f"'{{\"name\":\"', {addr}, ' check ', CAST(event_id AS STRING), '-{i}\",\"methods\":'",
                 arr("step", n_m), "',\"requirements\":'", arr("need", n_m)]
        if criteria:
            parts += ["',\"criteria\":'", arr("pass", n_c)]
        parts.append("'}'")
        return ", ".join(parts)

    obj = f"'{{\"test_items\":[', {item(1)}, ',', {item(2)}, '],\"meta\":', props, '}}'"
    return {"item1": item(1), "obj": obj, "item_nocrit": item(1, criteria=False)}


def output_sql() -> str:
    """Portable SQL for the model output text of each run."""
    it = _items_sql()
    return (
        "CASE WHEN event_id % 97 = 0 THEN '' "
        f"WHEN event_id % 10 = 0 THEN concat({it['obj']}) "
        f"WHEN event_id % 10 = 1 THEN concat('```json{NL}', {it['obj']}, '{NL}```') "
        f"WHEN event_id % 10 = 2 THEN concat('{IDEOGRAPHIC_SPACE}Result for run ', CAST(event_id AS STRING), ':{NL}', {it['obj']}, '{NL}Done.{IDEOGRAPHIC_SPACE}') "
        f"WHEN event_id % 10 = 3 THEN concat('[', {it['item1']}, ']') "
        f"WHEN event_id % 10 = 4 THEN concat('{{\"test_items\":[', {it['item_nocrit']}, ']}}') "
        "WHEN event_id % 10 = 5 THEN concat('{\"test_items\":[{\"name\":\"n', CAST(event_id AS STRING), "
        "'\",\"methods\":\"step one\",\"requirements\":[],\"criteria\":[]}]}') "
        f"WHEN event_id % 10 = 6 THEN concat('{{\"test_items\":[', {it['item1']}, ',{{\"name\":', CAST(event_id AS STRING), "
        "',\"methods\":[],\"requirements\":[],\"criteria\":[]}]}') "
        f"WHEN event_id % 10 = 7 THEN concat('{{\"test_items\":[', {it['item1']}) "
        "WHEN event_id % 10 = 8 THEN concat('I cannot produce the requested items for run ', CAST(event_id AS STRING), '.') "
        "ELSE '{\"test_items\":[]}' END"
    )


# First scores that are no finite number (JSON text).
ODD_SCORES = {"null": "null", "nan": '"NaN"', "infinite": '"-Infinity"'}


def judge_reply_sql() -> str:
    """Portable SQL for the judge model's reply to each successful run."""
    keys = [k for _, k, _ in S.DIMENSIONS]

    def body(style):
        parts = []
        for i, k in enumerate(keys):
            a = f"CAST(a{i + 1} AS STRING)"
            if style in ODD_SCORES and i == 0:
                v = f"'{ODD_SCORES[style]}'"
            elif style == "string":
                v = f"'\"', {a}, '\"'"
            elif style == "suffix" and i == 0:
                v = f"'\"', {a}, '分\"'"
            else:
                v = a
            if style == "missing" and i == len(keys) - 1:
                continue
            sep = "'{'" if not parts else "', '"
            parts.append(f"{sep}, '\"{k}\": ', {v}, ', \"{k}{S.EXPLANATION_SUFFIX}\": \"ok\"'")
        parts.append("'}'")
        return "concat(" + ", ".join(parts) + ")"

    odd = "".join(f" WHEN event_id % 55 = {11 * i} THEN {e}" for i, e in enumerate(
        [body("null"), body("nan"), body("infinite"), "'95'", "concat('[', CAST(a1 AS STRING), ', 2]')"]))
    return (
        "CASE" + odd + " WHEN event_id % 6 = 0 THEN " + body("number") +
        " WHEN event_id % 6 = 1 THEN " + body("string") +
        " WHEN event_id % 6 = 2 THEN " + body("suffix") +
        " WHEN event_id % 6 = 3 THEN " + body("missing") +
        " WHEN event_id % 6 = 4 THEN concat('Scores follow." + NL + "', " + body("number") + ", '" + NL + "End of evaluation.')"
        " ELSE 'The output could not be evaluated.' END"
    )


# What the generator records beside the text: a failed call has no tokens and no time.
OUTPUT_NUMBERS = [
    ("temperature", "CAST(event_id % 7 AS DOUBLE) / 10"),
    ("input_tokens", "CASE WHEN event_id % 97 <> 0 THEN 100 + user_id END"),
    ("elapsed_time", "CASE WHEN event_id % 97 <> 0 THEN value END"),
]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run table (without ``repeat_idx``; add it with ``with_repeat_idx``).

    Dimension lookups (J4-J6) are literal-map lookups of the configuration;
    Catalyst prunes every column a report does not read down to the parquet
    scan.
    """
    base = events(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in RUN_BASE])
    return failed_row_defaults(C.enrich_from_config(base).selectExpr(*[f"{e} AS {n}" for n, e in RUN_FINAL]))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_seq, scene_id, scheme_key, success, output_content) -- the
    generator's text.  The scan is spread over the cores first when the input
    is a single small split (see ``operators.balance``)."""
    return spread_files(events(spark, sf_dir).select("event_id", "user_id", "event_type", "props", "value")).selectExpr(
        "event_id AS run_seq",
        dict(RUN_BASE)["scene_id"] + " AS scene_id",
        dict(RUN_BASE)["scheme_key"] + " AS scheme_key",
        "event_id % 97 <> 0 AS success",
        *[f"{e} AS {n}" for n, e in OUTPUT_NUMBERS],
        output_sql() + " AS output_content")


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_seq, reply) for every successful run -- the judge model's text."""
    return (spread_files(events(spark, sf_dir).select("event_id"))
            .where("event_id % 97 <> 0")
            .selectExpr("event_id AS run_seq",
                        *[f"{e} AS {n}" for n, e in RUN_BASE if n.startswith("a")],
                        )
            .selectExpr("run_seq", judge_reply_sql().replace("event_id", "run_seq") + " AS reply"))


# The orthogonal experiment's parameter sets are T0..T4 (five temperatures).
ORTHOGONAL_PARAM_SET = "concat('T', CAST(event_id % 5 AS STRING))"


def orthogonal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run table in the orthogonal experiment's terms: parameter set T0..T4
    (temperature 0.0-1.2), orthogonal model names, group from the event id."""
    base_exprs = [(n, ORTHOGONAL_PARAM_SET if n == "param_set" else e) for n, e in RUN_BASE]
    base = events(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in base_exprs])
    return failed_row_defaults(C.enrich_from_config(base, orthogonal=True).selectExpr(*[f"{e} AS {n}" for n, e in RUN_FINAL]), orthogonal=True)


# Prompt parts for the prompt queries: scheme3 carries a system text, the user
# text names the scene and its registers.
PROMPT_SYSTEM_SQL = "CASE WHEN scheme_key = 'scheme3' THEN 'You are a senior test engineer.' ELSE '' END"
PROMPT_REGISTERS = {
    "sceneA": ["0x0000", "0x0002", "0x000E", "0x0010", "0x55AA"],
    "sceneB": ["0x0100", "0x0104", "0x0108"],
    "sceneC": ["0x0200", "0x0206", "0xEB90"],
}
# One judge template per scene, and the schemes' prompt parts as a configuration table.
JUDGE_TEMPLATES = {
    scene: f"Rubric of {name} ({{{{strict}}}}).\n" + JG.DEFAULT_JUDGE_TEMPLATE + f"\nScene {scene}."
    for scene, name in S.SCENES
}
SCHEME_PROMPTS = [
    [scene, scheme, "You are a senior test engineer.\u3000" if scheme == "scheme3" else (None if scheme == "scheme1" else ""),
     f"  Items for {scene} by {name}. " if (scene, scheme) != ("sceneC", "scheme2") else None]
    for scene, _ in S.SCENES for scheme, name in S.SCHEMES if (scene, scheme) != ("sceneB", "scheme1")
]


def prompt_registers_sql() -> str:
    return "CASE scene_id " + " ".join(f"WHEN '{k}' THEN '{', '.join(v)}'" for k, v in PROMPT_REGISTERS.items()) + " END"


# Model outputs built from whole ``documents`` texts: every line of a document
# becomes a list entry (quotes, tabs and CRs blanked so lines are JSON-safe),
# in shapes chosen by the document id -- fenced, plain, truncated, wrapped.
def document_output_sql(dialect: str = "spark") -> str:
    """Portable SQL for one output text per document; ``dialect`` only picks
    the names of the two list functions."""
    clean = """translate(text, '"' || chr(9) || chr(13), '   ')"""
    if dialect == "duckdb":
        lines = f"string_split({clean}, chr(10))"
        join, short = "array_to_string", f"list_slice({lines}, 1, greatest(len({lines}) - 1, 1))"
    else:
        lines = f"split({clean}, chr(10))"
        join, short = "array_join", f"slice({lines}, 1, greatest(size({lines}) - 1, 1))"
    q = "'\"'"
    full = f"concat('[', {q}, {join}({lines}, '\",\"'), {q}, ']')"
    part = f"concat('[', {q}, {join}({short}, '\",\"'), {q}, ']')"
    crit = f"CASE WHEN doc_id % 3 = 0 THEN {part} ELSE {full} END"
    obj = ("concat('{\"test_items\":[{\"name\":\"document ', CAST(doc_id AS STRING), "
           f"'\",\"methods\":', {full}, ',\"requirements\":', {full}, ',\"criteria\":', {crit}, '}}]}}')")
    return (f"CASE WHEN doc_id % 4 = 0 THEN concat('```json', chr(10), {obj}, chr(10), '```') "
            f"WHEN doc_id % 4 = 1 THEN {obj} "
            f"WHEN doc_id % 4 = 2 THEN substring({obj}, 1, length({obj}) - 1) "
            f"ELSE concat('Here are the items:', chr(10), {obj}, chr(10), 'End.') END")


def document_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_seq = doc_id, output_content) built from whole document texts."""
    docs = spread_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.selectExpr("doc_id AS run_seq", document_output_sql() + " AS output_content")


# JSON texts in odd spelling, one per document: the whole text as a string with
# its escapes, keys and characters escaped without need, a repeated key, numbers
# that print otherwise than they are written, empty containers.
_BACKSLASH = "chr(92)"


def _escaped_sql() -> str:
    other = [c for c in range(1, 32) if c not in (9, 10, 13)]
    text = f"translate(text, concat({', '.join(f'chr({c})' for c in other)}), '{' ' * len(other)}')"
    for code, letter in [("chr(92)", _BACKSLASH), ("'\"'", "'\"'"), ("chr(10)", "'n'"), ("chr(9)", "'t'"), ("chr(13)", "'r'")]:
        text = f"replace({text}, {code}, concat({_BACKSLASH}, {letter}))"
    return text


def odd_json_sql() -> str:
    u = lambda code: f"{_BACKSLASH}, 'u{code}'"
    return (f"concat('{{ \"id\":', CAST(doc_id AS STRING), ',\"text\" :\"', {_escaped_sql()}, '\",\"', {u('0061')}, {_BACKSLASH}, '/b\":[ ', "
            f"CAST(n_chars AS STRING), '.50 ,-0,', CAST(doc_id AS STRING), 'e3, 1E-7,NaN ,[],{{ }} ,\"', {u('d83d')}, {u('DE00')}, {u('00e9')}, {u('001F')}, '\"],\"lang\":', "
            "CASE WHEN lang IS NULL THEN 'null' ELSE concat('\"', lang, '\"') END, ',\"id\":', CAST(doc_id + 1 AS STRING), '}')")


def even_json_sql() -> str:
    """What the texts of ``odd_json_sql`` are in canonical form."""
    line = lambda depth, text: f"chr(10), '{'  ' * depth}{text}'"
    thousands = "CASE WHEN doc_id = 0 THEN '0.0' ELSE concat(CAST(doc_id AS STRING), '000.0') END"
    return (f"concat('{{', {line(1, chr(34) + 'id' + chr(34) + ': ')}, CAST(doc_id + 1 AS STRING), ',', {line(1, chr(34) + 'text' + chr(34) + ': ' + chr(34))}, {_escaped_sql()}, '\",', "
            f"{line(1, chr(34) + 'a/b' + chr(34) + ': [')}, {line(2, '')}, CAST(n_chars AS STRING), '.5,', {line(2, '0,')}, {line(2, '')}, {thousands}, ',', "
            f"{line(2, '1e-07,')}, {line(2, 'NaN,')}, {line(2, '[],')}, {line(2, '{},')}, {line(2, chr(34) + chr(0x1F600) + chr(0xE9))}, {_BACKSLASH}, 'u001f\"', {line(1, '],')}, "
            f"{line(1, chr(34) + 'lang' + chr(34) + ': ')}, CASE WHEN lang IS NULL THEN 'null' ELSE concat('\"', lang, '\"') END, chr(10), '}}')")


def odd_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, json) built from whole documents."""
    docs = spread_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "n_chars"))
    return docs.selectExpr("doc_id", odd_json_sql() + " AS json")
