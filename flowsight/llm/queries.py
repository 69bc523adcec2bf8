"""Registered queries of the training-data operators."""

from __future__ import annotations

from flowsight.llm.alignment import op12_alignment
from flowsight.llm.anchors import op4_substring_dedup
from flowsight.llm.archive import op9_token_archive
from flowsight.llm.contamination import op3_decontamination
from flowsight.llm.discriminant import op13_quality_classifier
from flowsight.llm.licences import op2_licences
from flowsight.llm.lines import op10_line_dedup
from flowsight.llm.packing import op6_packing
from flowsight.llm.personal import op1_personal_data
from flowsight.llm.quality import op7_repetition
from flowsight.llm.resampling import op11_resampling
from flowsight.llm.simhash import op5_simhash
from flowsight.llm.suffixes import op8_suffix_dedup

QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_licences": op2_licences,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_repetition": op7_repetition,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_archive": op9_token_archive,
    "op10_line_dedup": op10_line_dedup,
    "op11_resampling": op11_resampling,
    "op12_alignment": op12_alignment,
    "op13_quality_classifier": op13_quality_classifier,
}
ORACLES: dict[str, str] = {}
