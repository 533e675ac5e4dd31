"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from .byte_bpe import op7_byte_bpe
from .chat_format import op10_chat_formatting, op10_oracle
from .embedding_dedup import op6_embedding_dedup
from .hamming_search import op8_nearest_neighbours
from .html_extract import op9_html_extraction
from .minhash_dedup import op1_minhash_dedup
from .mixing import op4_mixing
from .quality import op5_quality_classifier
from .secret_scan import op3_secret_scans
from .url_filter import op2_oracle, op2_url_filters


def queries() -> dict:
    found = (op1_minhash_dedup, op2_url_filters, op3_secret_scans, op4_mixing, op5_quality_classifier, op6_embedding_dedup, op7_byte_bpe, op8_nearest_neighbours, op9_html_extraction, op10_chat_formatting)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": op2_oracle(), "op10_chat_formatting": op10_oracle()}
