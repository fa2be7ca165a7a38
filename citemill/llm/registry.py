"""The corpus operators' queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from . import decontaminate, divergence, language, line_dedup, main_text, manifest, quality, secret_scan, sentencepiece_codec, simhash, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_warc": warc.op5_warc,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_language": language.op7_language,
        "op8_simhash": simhash.op8_simhash,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_secrets": secret_scan.op10_secrets,
        "op11_divergence": divergence.op11_divergence,
        "op12_main_text": main_text.op12_main_text,
        "op13_manifest": manifest.op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.SQL,
        "op5_warc": warc.SQL,
        "op9_decontaminate": decontaminate.SQL,
        "op11_divergence": divergence.SQL,
        "op13_manifest": manifest.SQL,
    }
