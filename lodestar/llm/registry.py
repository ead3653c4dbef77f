"""The subpackage's queries and their SQL."""

from __future__ import annotations

from .bpe import op8_byte_bpe
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .langid import op9_language
from .licenses import OP2_SQL, op2_licenses
from .line_dedup import OP4_SQL, op4_line_dedup
from .near_join import op5_near_join
from .packing import op3_packing
from .quality import op7_quality
from .topk import OP1_SQL, op1_topk
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_topk": op1_topk,
    "op2_licenses": op2_licenses,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_join": op5_near_join,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_language": op9_language,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL = {
    "op1_topk": OP1_SQL,
    "op2_licenses": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_warc": OP6_SQL,
    "op10_exact_dedup": OP10_SQL,
}
