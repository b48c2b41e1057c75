"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from . import decontaminate, filter_audit, langid, licenses, lm_scoring, media, mixing, phrases, quality, simhash, suffix_dedup, token_counts, url_filter

QUERIES = {
    "op1_media_avi": media.op1,
    "op2_license_scan": licenses.op2,
    "license_scan_planted": licenses.planted,
    "op3_decontaminate": decontaminate.op3,
    "op4_url_filter": url_filter.op4,
    "url_filter_planted": url_filter.planted,
    "op5_lm_score": lm_scoring.op5,
    "op6_simhash": simhash.op6,
    "op7_mix_sources": mixing.op7,
    "op8_language_id": langid.op8,
    "op9_suffix_dedup": suffix_dedup.op9,
    "op10_quality_fm": quality.op10,
    "op11_token_counts": token_counts.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_phrases": phrases.op13,
}

ORACLES = {"op2_license_scan": licenses.ORACLE, "license_scan_planted": licenses.PLANTED_ORACLE, "op4_url_filter": url_filter.ORACLE, "url_filter_planted": url_filter.PLANTED_ORACLE, "op5_lm_score": lm_scoring.ORACLE, "op7_mix_sources": mixing.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_phrases": phrases.ORACLE}
