"""The registered query of each operator, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, jaccard, licenses, lm, media, mixing, packing, pii, quality, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.query,
        "op2_media": media.query,
        "op3_license_scan": licenses.query,
        "op4_jaccard_join": jaccard.query,
        "op5_packing": packing.query,
        "op6_fingerprints": fingerprints.query,
        "op7_pii": pii.query,
        "op8_mixing": mixing.query,
        "op9_language_model": lm.query,
        "op10_quality": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.ORACLE,
        "op3_license_scan": licenses.ORACLE,
        "op4_jaccard_join": jaccard.ORACLE,
        "op6_fingerprints": fingerprints.ORACLE,
        "op8_mixing": mixing.ORACLE,
    }
