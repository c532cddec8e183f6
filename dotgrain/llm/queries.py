"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op3_bpe
from .fingerprint import op10_fingerprint
from .embedding_dedup import OP8_SQL, op8_embedding_dedup
from .mixing import op2_mixing
from .jaccard_join import op4_jaccard_join
from .language_id import op6_language_id
from .line_dedup import OP7_SQL, op7_line_dedup
from .pii import op9_pii
from .substring_dedup import op1_substring_dedup
from .toxicity import op5_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_bpe": op3_bpe,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_pii": op9_pii,
    "op10_fingerprint": op10_fingerprint,
}
ORACLE = {"op7_line_dedup": OP7_SQL, "op8_embedding_dedup": OP8_SQL}
