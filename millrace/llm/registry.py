"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

import corpus_pipeline

from .exact_dedup import OP4_SQL, op4_exact_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .language_id import op2_language_id
from .mixing import op1_mixing
from .packing import op9_packing
from .pii import op11_pii
from .simhash import op6_simhash
from .suffix_dedup import op10_suffix_dedup
from .toxicity import op5_toxicity
from .url_filter import OP7_SQL, op7_url_filter
from .vector_codes import OP13_SQL, op13_vector_codes
from .warc import op8_warc
from .webp import op3_webp

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_webp": op3_webp,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_url_filter": op7_url_filter,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_pii": op11_pii,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op4_exact_dedup": OP4_SQL,
    "op7_url_filter": OP7_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
