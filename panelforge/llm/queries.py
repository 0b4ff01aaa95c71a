"""The queries of this subpackage, for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP11_SQL, op11_chat_format
from .contamination import op9_decontamination
from .counts import op1_token_counts
from .packing import op6_packing
from .pstable import op3_vector_near_dedup
from .quality import op8_quality
from .repair import op12_conversation_repair
from .simhash import op5_simhash
from .suffixes import op4_suffix_dedup
from .tokenfile import op10_token_file
from .toxicity import op7_toxicity
from .warc import OP2_SQL, op2_warc
from .whitening import op13_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_token_counts,
        op2_warc,
        op3_vector_near_dedup,
        op4_suffix_dedup,
        op5_simhash,
        op6_packing,
        op7_toxicity,
        op8_quality,
        op9_decontamination,
        op10_token_file,
        op11_chat_format,
        op12_conversation_repair,
        op13_whitening,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op11_chat_format": OP11_SQL}
