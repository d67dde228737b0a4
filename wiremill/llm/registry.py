"""Queries of this subpackage and their DuckDB twins, for ``__spark_entry__``."""

from __future__ import annotations

from wiremill.llm.conversation_repair import op12_conversation_repair
from wiremill.llm.decontamination import op2_decontamination
from wiremill.llm.katz_lm import op7_katz_lm
from wiremill.llm.language_id import op1_language_id
from wiremill.llm.line_templates import OP4_SQL, op4_line_templates
from wiremill.llm.packing import op10_packing
from wiremill.llm.periodic_runs import op13_periodic_runs
from wiremill.llm.quality_gam import op5_quality_gam
from wiremill.llm.quality_rules import op8_quality_rules
from wiremill.llm.simhash_dedup import op6_simhash_dedup
from wiremill.llm.suffix_dedup import op3_suffix_dedup
from wiremill.llm.token_files import op11_token_files
from wiremill.llm.url_filter import op9_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_line_templates": op4_line_templates,
    "op5_quality_gam": op5_quality_gam,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_katz_lm": op7_katz_lm,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filter": op9_url_filter,
    "op10_packing": op10_packing,
    "op11_token_files": op11_token_files,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {"op4_line_templates": OP4_SQL}
