"""The queries of this subpackage and, where SQL can express them, the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import op9_decontamination
from .html_text import op6_html_text
from .langid import op4_language_id
from .lm_score import op10_lm_score
from .mixing import OP2_SQL, op2_mixing
from .near_dups import op3_near_dups
from .quality import OP8_SQL, op8_line_quality
from .token_counts import op5_token_counts
from .token_records import op1_token_records
from .warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_mixing": op2_mixing,
    "op3_near_dups": op3_near_dups,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_html_text": op6_html_text,
    "op7_warc": op7_warc,
    "op8_line_quality": op8_line_quality,
    "op9_decontamination": op9_decontamination,
    "op10_lm_score": op10_lm_score,
}

ORACLES: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op8_line_quality": OP8_SQL,
}
