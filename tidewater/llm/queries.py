"""The numbered queries and their SQL."""

from __future__ import annotations

from .bit_sliced import OP2_SQL, op2_bit_sliced_topk
from .block_max_wand import OP12_SQL, op12_block_max_wand
from .byte_bpe import op6_byte_bpe
from .fim import OP13_SQL, op13_fill_in_middle
from .hmm import op11_hmm
from .ivf_pq import op9_ivf_pq
from .licenses import OP7_SQL, op7_license_scan
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import op4_mixing
from .quality import op3_quality
from .simhash import op5_simhash
from .suffix_dedup import op8_suffix_dedup
from .toxicity import op10_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_bit_sliced_topk": op2_bit_sliced_topk,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_ivf_pq": op9_ivf_pq,
    "op10_toxicity": op10_toxicity,
    "op11_hmm": op11_hmm,
    "op12_block_max_wand": op12_block_max_wand,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE = {"op1_line_dedup": OP1_SQL, "op2_bit_sliced_topk": OP2_SQL, "op7_license_scan": OP7_SQL, "op12_block_max_wand": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
