"""The queries of this package by name, with their SQL where SQL can express them."""

from __future__ import annotations

from trailmark.llm.alignment import op11_alignment
from trailmark.llm.byte_bpe import op13_byte_bpe
from trailmark.llm.collocations import OP12_SQL, op12_collocations
from trailmark.llm.fingerprints import op10_fingerprints
from trailmark.llm.language_model import op9_language_model
from trailmark.llm.line_dedup import OP2_SQL, op2_line_dedup
from trailmark.llm.mixing import OP7_SQL, op7_mixing
from trailmark.llm.near_dedup import OP4_SQL, op4_near_dedup
from trailmark.llm.nearest import op3_nearest
from trailmark.llm.packing import op1_packing
from trailmark.llm.quality import op6_quality
from trailmark.llm.suffix_dedup import op5_suffix_dedup
from trailmark.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_nearest": op3_nearest,
    "op4_near_dedup": op4_near_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_language_model": op9_language_model,
    "op10_fingerprints": op10_fingerprints,
    "op11_alignment": op11_alignment,
    "op12_collocations": op12_collocations,
    "op13_byte_bpe": op13_byte_bpe,
}

SQL = {
    "op2_line_dedup": OP2_SQL,
    "op4_near_dedup": OP4_SQL,
    "op7_mixing": OP7_SQL,
    "op12_collocations": OP12_SQL,
}
