"""Queries of this subpackage by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm.addressable_codes import op6_addressable_codes
from sheaf.llm.best_fit import op7_best_fit
from sheaf.llm.bucket_digest import op3_bucket_digest
from sheaf.llm.language_id import op8_language_id
from sheaf.llm.order_minhash import op5_order_minhash
from sheaf.llm.pii import op1_pii_pseudonyms
from sheaf.llm.secrets import op4_secret_scan
from sheaf.llm.string_tiling import op10_string_tiling
from sheaf.llm.suffix_dedup import op2_suffix_dedup
from sheaf.llm.url_filter import op9_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_pseudonyms,
        op2_suffix_dedup,
        op3_bucket_digest,
        op4_secret_scan,
        op5_order_minhash,
        op6_addressable_codes,
        op7_best_fit,
        op8_language_id,
        op9_url_filter,
        op10_string_tiling,
    )
}
#: None of the ten can be written in SQL; each is tested against brute force, a round trip or held-out accuracy instead.
ORACLES: dict[str, str] = {}
