"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import line_quality, mixing, near_dedup, warc_fixity
from .classifier import op8_quality_classifier
from .fingerprints import op1_iblt_fingerprints
from .license_scan import op7_license_scan
from .line_quality import op4_line_quality
from .mixing import op10_mix_sources
from .near_dedup import op2_minhash_dedup
from .packing import op3_best_fit_packing
from .pii import op6_pii_spans
from .secret_scan import op9_secret_scan
from .warc_fixity import op5_merkle_fixity


def queries() -> dict:
    return {
        "op1_iblt_fingerprints": op1_iblt_fingerprints,
        "op2_minhash_dedup": op2_minhash_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_line_quality": op4_line_quality,
        "op5_merkle_fixity": op5_merkle_fixity,
        "op6_pii_spans": op6_pii_spans,
        "op7_license_scan": op7_license_scan,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_secret_scan": op9_secret_scan,
        "op10_mix_sources": op10_mix_sources,
    }


def oracle_sql() -> dict:
    return {"op2_minhash_dedup": near_dedup.ORACLE, "op4_line_quality": line_quality.ORACLE, "op5_merkle_fixity": warc_fixity.ORACLE, "op10_mix_sources": mixing.ORACLE}
