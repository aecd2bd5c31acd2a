"""Registry of the corpus operators' queries."""

from __future__ import annotations

from . import chat, mixing, urls
from .chat import op9
from .katz import op7
from .mixing import op10
from .neardup import op1
from .packing import op8
from .quality import op6
from .repeats import op4
from .sharding import op3
from .urls import op2
from .vectors import op5

QUERIES = {
    "op1_near_dedup": op1,
    "op2_url_filters": op2,
    "op3_sharding": op3,
    "op4_substring_dedup": op4,
    "op5_embedding_dedup": op5,
    "op6_quality_rules": op6,
    "op7_lm_scoring": op7,
    "op8_best_fit_packing": op8,
    "op9_chat_formatting": op9,
    "op10_source_mixing": op10,
}

#: SQL for those operators whose result SQL can express.
ORACLE: dict[str, str] = {"op2_url_filters": urls.ORACLE_SQL, "op9_chat_formatting": chat.ORACLE_SQL, "op10_source_mixing": mixing.ORACLE_SQL}
