"""The operators' queries over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op5_latent_decontamination
from .html_extraction import op2_crf_html_extraction
from .line_dedup import OP9_EVERY_SQL, OP9_LONG_SQL, OP9_SQL, op9_every_line_dedup, op9_line_dedup, op9_long_line_dedup
from .media import op3_interleaved_media
from .near_dedup import op8_tensored_minhash
from .packing import op10_power_of_two_packing
from .pii import op7_bilstm_crf_pii
from .quality import op11_positive_unlabelled_quality
from .source_divergence import OP12_SQL, op12_source_divergence
from .spelling import op13_spelling_variants
from .substring_dedup import op6_prefix_free_parsing
from .token_files import op4_repair_token_files
from .toxicity import op1_noisy_channel_toxicity

_QUERIES = [op1_noisy_channel_toxicity, op2_crf_html_extraction, op3_interleaved_media, op4_repair_token_files, op5_latent_decontamination, op6_prefix_free_parsing, op7_bilstm_crf_pii, op8_tensored_minhash, op9_line_dedup, op9_every_line_dedup, op9_long_line_dedup, op10_power_of_two_packing, op11_positive_unlabelled_quality, op12_source_divergence, op13_spelling_variants]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": OP9_SQL, "op9_every_line_dedup": OP9_EVERY_SQL, "op9_long_line_dedup": OP9_LONG_SQL, "op12_source_divergence": OP12_SQL}
