"""The queries of this package, for ``__spark_entry__``: name to callable, and DuckDB SQL where SQL says the same."""

from __future__ import annotations

from . import bpe, jpeg, lexical, minhash, mixing, oracles, quality, repeats, rules, tokenfile, toxicity, urls, variants, warc

QUERIES = {
    "op1_warc": warc.op1,
    "op2_minhash_near_dedup": minhash.op2,
    "op7_quality_classifier": quality.op7,
    "op3_quality_rules": rules.op3,
    "op4_mixing_target_weights": mixing.op4,
    "op5_token_id_output": tokenfile.op5,
    "op8_byte_level_bpe": bpe.op8,
    "op6_toxicity": toxicity.op6,
    "op9_url_filters": urls.op9,
    "op10_progressive_jpeg": jpeg.op10,
    "op11_spelling_variants": variants.op11,
    "op12_suffix_array_dedup": repeats.op12,
    "op13_lexical_search": lexical.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op2_minhash_near_dedup": oracles.OP2_SQL,
    "op3_quality_rules": rules.OP3_SQL,
    "op11_spelling_variants": variants.OP11_SQL,
    "op12_suffix_array_dedup": repeats.OP12_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
