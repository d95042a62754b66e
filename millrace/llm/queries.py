"""The queries of this subpackage, by name, with SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op2_bpe_round_trip
from .exact_dedup import ORACLE_OP8, op8_exact_dedup
from .html_extract import op1_html_extraction
from .media import op7_media_columns
from .packing import op10_packing
from .pii import op5_pii
from .quality import op9_quality
from .secrets import op3_secret_scan
from .secrets import oracle as oracle_op3
from .sharding import op4_sharding
from .simhash_dedup import op6_simhash_near_dedup

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_secret_scan": op3_secret_scan,
    "op4_sharding": op4_sharding,
    "op5_pii": op5_pii,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_media_columns": op7_media_columns,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
}

ORACLES = {
    "op3_secret_scan": oracle_op3(),
    "op8_exact_dedup": ORACLE_OP8,
}
