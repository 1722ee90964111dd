"""The registered training-data queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from .align import op12_merge_path
from .decontaminate import op4_decontaminate
from .html_text import op2_site_template
from .media import op9_motion_jpeg
from .near_dup import op3_setsketch
from .periodic import op13_periodic_runs
from .permutation import op11_permutation_index
from .pieces import op1_merge_dropout
from .quality import op6_line_crf
from .sharding import op10_weighted_tree
from .sql import ORACLE_SQL
from .substring import op5_fm_index
from .suffix_array import op8_suffix_array
from .toxicity import op7_classifier_chain

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_merge_dropout, op2_site_template, op3_setsketch, op4_decontaminate, op5_fm_index, op6_line_crf, op7_classifier_chain, op8_suffix_array, op9_motion_jpeg, op10_weighted_tree, op11_permutation_index, op12_merge_path, op13_periodic_runs)}
