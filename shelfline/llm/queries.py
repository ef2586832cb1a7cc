"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroid_clustering, chat_rotation, decontamination, embedding_dedup, fill_in_middle, minhash_dedup
from .best_fit_packing import op5_best_fit_packing
from .html_extraction import op6_html_extraction
from .importance_resampling import op9_importance_resampling
from .personal_data import op12_personal_data
from .sharding import op1_sharding
from .token_counts import op7_token_counts
from .toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_chat_rotation": chat_rotation.op3_chat_rotation,
    "op4_minhash_dedup": minhash_dedup.op4_minhash_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_html_extraction": op6_html_extraction,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_personal_data": op12_personal_data,
    "op13_centroid_clustering": centroid_clustering.op13_centroid_clustering,
}
ORACLE_SQL: dict[str, str] = {
    "op3_chat_rotation": chat_rotation.ORACLE,
    "op4_minhash_dedup": minhash_dedup.ORACLE,
    "op8_decontamination": decontamination.ORACLE,
    "op10_embedding_dedup": embedding_dedup.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op13_centroid_clustering": centroid_clustering.ORACLE,
}
