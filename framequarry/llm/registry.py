"""The subpackage's queries by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .alignment import op13_tokenizer_alignment
from .bpe import op11_bpe
from .jaccard_join import op6_jaccard_join
from .lattice_lm import op4_lattice_lm
from .license_scan import op10_license_scan
from .line_dedup import op8_line_dedup
from .mixing import op9_mix_sources
from .near_vectors import op7_near_vectors
from .oracles import ORACLES
from .packing import op5_best_fit_packing
from .periodic import op12_periodic_runs
from .quality_net import op3_quality_net
from .quality_rules import op2_quality_rules
from .suffix_dedup import op1_suffix_dedup

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_net": op3_quality_net,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_near_vectors": op7_near_vectors,
    "op8_line_dedup": op8_line_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_license_scan": op10_license_scan,
    "op11_bpe": op11_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

__all__ = ["ORACLES", "QUERIES"]
