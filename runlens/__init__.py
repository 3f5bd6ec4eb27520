"""runlens: experiment-results analytics on Spark.

Design grids, resume anti-joins, model-output JSON validation, judge-reply
parsing and score reports, all as DataFrame -> DataFrame / Column -> Column
functions built from Spark's own operators (no Python UDFs).

The names below are the public surface; submodules hold the details.
"""

__version__ = "0.1.0"

from runlens.functions.jsoncheck import (  # noqa: F401,E402
    canonical_json, check_outputs, entry_counts_equal, format_points, normalize_columns,
    document_of, unknown_addresses,
)
from runlens.functions.jsontext import canonical_text  # noqa: F401,E402
from runlens.functions.judge import (  # noqa: F401,E402
    judge_prompt, judge_prompts, parse_judge_replies, render_template,
)
from runlens.functions.metrics import composite_score, np_round, py_round  # noqa: F401,E402
from runlens.functions.text import (  # noqa: F401,E402
    chat_messages, hex_addresses, json_span, prompt_text, strip_code_fence, trim_unicode,
)
from runlens.operators.assemble import assemble_runs, failed_row_defaults, with_prompts  # noqa: F401,E402
from runlens.operators.ranking import global_rank, last_by_key, seq_rank  # noqa: F401,E402
from runlens.operators.reports import (  # noqa: F401,E402
    best_configuration, best_vs_baseline, composite_by_config, consistency_report, consistency_scores,
    detail, factor_effect, first_appearance, group_statistics, interaction_table, main_results,
    main_summary, orthogonal_report_tables, overall_statistics, report_tables, scene_sheets, sensitivity,
    summary_statistics,
    with_composite, with_repeat_idx,
)
from runlens.plans.design import (  # noqa: F401,E402
    configurations, designs_from_config, exploratory_designs, orthogonal_designs, plan, plan_size,
    weights_from_config,
)
from runlens.plans.resume import (  # noqa: F401,E402
    canonical_key_from_file_name, completed_keys, exploratory_key, orthogonal_key, pending, progress,
    skipped, union_keys, with_design, with_keys_from_names,
)
from runlens.sinks.files import (  # noqa: F401,E402
    export_csv, merge_raw_outputs, write_bucketed, write_raw_outputs, write_reports, write_runs,
)
from runlens.sources.files import (  # noqa: F401,E402
    file_order, list_raw_output_names, read_progress, read_raw_outputs, read_runs, read_runs_csv,
)
