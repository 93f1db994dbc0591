"""The registered queries of the text operators and their SQL oracles."""

from __future__ import annotations

from . import collocations, html, language, mixing, near_dup, neighbours, packing, pieces, quality, secrets, token_file, toxicity, variants


def queries() -> dict:
    return {
        "op1_nearest_neighbours": neighbours.op1_nearest_neighbours,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_html_extraction": html.op3_html_extraction,
        "op4_sentencepiece": pieces.op4_sentencepiece,
        "op5_source_mixing": mixing.op5_source_mixing,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_language_id": language.op7_language_id,
        "op8_token_file": token_file.op8_token_file,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_minhash_near_dedup": near_dup.op10_minhash_near_dedup,
        "op11_spelling_variants": variants.op11_spelling_variants,
        "op12_best_fit_packing": packing.op12_best_fit_packing,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict:
    return {"op2_quality_rules": quality.oracle(), "op5_source_mixing": mixing.oracle(), "op13_collocations": collocations.oracle()}
