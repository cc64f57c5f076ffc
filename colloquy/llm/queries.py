"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_byte_bpe
from .langid import op6_language_id
from .lm import op1_brown_lm
from .mixing import OP3_SQL, op3_mix_sources
from .neardup import OP8_SQL, op8_near_duplicates
from .neighbours import op7_nearest_neighbours
from .pii import op2_pii
from .quality import op9_quality_rules
from .urlfilter import OP10_SQL, op10_url_filter
from .warc import OP5_SQL, op5_warc_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_lm": op1_brown_lm,
    "op2_pii": op2_pii,
    "op3_mix_sources": op3_mix_sources,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_warc_archive": op5_warc_archive,
    "op6_language_id": op6_language_id,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_filter": op10_url_filter,
}
ORACLE: dict[str, str] = {"op3_mix_sources": OP3_SQL, "op5_warc_archive": OP5_SQL, "op8_near_duplicates": OP8_SQL, "op10_url_filter": OP10_SQL}
