"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import op8_decontaminate
from .language import op9_language
from .lm_scoring import op13_lm_scores
from .packing import op4_packing
from .quality_rules import op10_quality_rules
from .search import OP12_SQL, op12_search
from .sessions import OP11_SQL, op11_late_sessions
from .simhash import op5_simhash
from .suffix_dedup import OP2_SQL, op2_suffix_dedup
from .token_files import op6_token_counts
from .toxicity import op7_toxicity
from .warc import OP3_SQL, op3_warc
from .weak_labels import op1_weak_labels

QUERIES = {
    "op1_weak_labels": op1_weak_labels,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op9_language": op9_language,
    "op10_quality_rules": op10_quality_rules,
    "op11_late_sessions": op11_late_sessions,
    "op12_search": op12_search,
    "op13_lm_scores": op13_lm_scores,
}

ORACLE_SQL: dict[str, str] = {"op2_suffix_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op11_late_sessions": OP11_SQL, "op12_search": OP12_SQL}
