"""The registered queries of the training-data operators: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from . import ann, bpe, ctw, forest, langid, lpf, manifest, mixing, periods, quality, ship_by_value, toxicity, units, warc

ship_by_value()

OPS = {
    "op1_ftrl_toxicity": (toxicity.query, None),
    "op2_lpf_dedup": (lpf.query, None),
    "op3_learned_partitions": (ann.query, None),
    "op4_quality_rules": (quality.query, quality.SQL),
    "op5_unit_dedup": (units.query, units.SQL),
    "op6_minhash_forest": (forest.query, None),
    "op7_warc": (warc.query, warc.SQL),
    "op8_byte_bpe": (bpe.query, None),
    "op9_curriculum_mix": (mixing.query, mixing.SQL),
    "op10_language_mixture": (langid.query, None),
    "op11_context_tree": (ctw.query, None),
    "op12_periodic_runs": (periods.query, None),
    "op13_merkle_manifest": (manifest.query, manifest.SQL),
}
