"""The subpackage's queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .align import op12_alignment
from .bloomrank import SEARCH_SQL, op11_search
from .decontam import op10_decontamination
from .jpeg import op2_media
from .langid import op13_language
from .licenses import op3_licenses
from .neardup import op8_near_duplicates
from .packing import op9_packed_sequences
from .pfor import op5_token_files
from .pii import op4_pseudonyms
from .secrets import op6_secrets
from .suffix import op7_repeats
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_media": op2_media,
    "op3_licenses": op3_licenses,
    "op6_secrets": op6_secrets,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_token_files": op5_token_files,
    "op7_repeats": op7_repeats,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_packed_sequences": op9_packed_sequences,
    "op10_decontamination": op10_decontamination,
    "op11_search": op11_search,
    "op12_alignment": op12_alignment,
    "op13_language": op13_language,
}

ORACLE_SQL: dict[str, str] = {"op11_search": SEARCH_SQL}
