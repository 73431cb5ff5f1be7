"""The queries of this subpackage by name, and their SQL where there is one."""

from __future__ import annotations

from glossa.llm import decontaminate, filteraudit, jaccard, linededup, mixture, pii, qualityrules, qualityscore, secrets, tokencount, toxicity, urlfilter, whitening

_MODULES = {
    "op1_pii": pii,
    "op2_token_counts": tokencount,
    "op3_decontamination": decontaminate,
    "op4_source_mixing": mixture,
    "op5_secrets": secrets,
    "op6_quality_classifier": qualityscore,
    "op7_ngram_jaccard": jaccard,
    "op8_url_filter": urlfilter,
    "op9_line_dedup": linededup,
    "op10_quality_rules": qualityrules,
    "op11_filter_audit": filteraudit,
    "op12_toxicity": toxicity,
    "op13_whitening": whitening,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
SQL = {name: module.SQL for name, module in _MODULES.items() if module.SQL}
