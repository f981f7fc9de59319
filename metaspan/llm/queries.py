"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metaspan.llm.bpe import op5_bpe_encode
from metaspan.llm import license_scan, url_filter
from metaspan.llm.collinear import op2_collinear_chaining
from metaspan.llm.embedding_dedup import op7_hnsw_dedup
from metaspan.llm.iblt_fingerprint import op3_iblt_fingerprint
from metaspan.llm.jaccard_join import op9_jaccard_join
from metaspan.llm.pfair_mix import op10_pfair_mix
from metaspan.llm.pu_quality import op1_quality_classifier
from metaspan.llm.suffix_dedup import op4_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_collinear_chaining": op2_collinear_chaining,
    "op3_iblt_fingerprint": op3_iblt_fingerprint,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_bpe_encode": op5_bpe_encode,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_hnsw_dedup": op7_hnsw_dedup,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_pfair_mix": op10_pfair_mix,
}
ORACLES: dict[str, str] = {"op6_url_filter": url_filter.SQL, "op8_license_scan": license_scan.SQL}
