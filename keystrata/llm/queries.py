"""The corpus operators' queries and their SQL twins."""

from __future__ import annotations

from . import chat_format, source_mix, topk_search
from .chat_format import op4_chat_format
from .decontaminate import op10_decontaminate
from .language_id import op9_language_id
from .license_scan import op1_license_scan
from .quality import op7_quality
from .simhash import op8_simhash
from .source_mix import op2_source_mix
from .substring_dedup import op3_substring_dedup
from .token_files import op5_token_files
from .topk_search import op6_topk_search

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_source_mix": op2_source_mix,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_token_files": op5_token_files,
    "op6_topk_search": op6_topk_search,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
}

#: DuckDB SQL, where it can express the query; the others are tested against brute-force versions in tests/llm.
ORACLES: dict[str, str] = {
    "op2_source_mix": source_mix.ORACLE_SQL,
    "op4_chat_format": chat_format.ORACLE_SQL,
    "op6_topk_search": topk_search.ORACLE_SQL,
}
