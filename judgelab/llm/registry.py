"""Queries of the training-data operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from judgelab.llm.decontamination import op6_decontamination
from judgelab.llm.license_scan import op13_license_scan
from judgelab.llm.lm import op2_lm_scoring
from judgelab.llm.merkle import op12_merkle_manifest
from judgelab.llm.minhash import op4_minhash_near_dedup
from judgelab.llm.mixing import op1_mixing
from judgelab.llm.oracles import ORACLES
from judgelab.llm.prefix_trie import op11_prefix_trie
from judgelab.llm.quality_classifier import op5_quality_classifier
from judgelab.llm.quality_rules import op7_quality_rules
from judgelab.llm.sharding import op9_sharding
from judgelab.llm.substring_dedup import op3_substring_dedup
from judgelab.llm.toxicity import op8_toxicity
from judgelab.llm.url_filters import op10_url_filters

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_url_filters": op10_url_filters,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_license_scan": op13_license_scan,
}
