"""Queries of this subpackage, by name, and their SQL twins."""

from . import chat, classifier, decontamination, line_dedup, mixing, ngram_join, quality_rules, secrets, suffix_dedup, url_filters

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_ngram_join": ngram_join.query,
    "op3_decontamination": decontamination.query,
    "op4_quality_rules": quality_rules.query,
    "op5_url_filters": url_filters.query,
    "op6_secret_scan": secrets.query,
    "op7_quality_classifier": classifier.query,
    "op8_chat_formatting": chat.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_mixing": mixing.query,
}
ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_ngram_join": ngram_join.SQL,
    "op3_decontamination": decontamination.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op8_chat_formatting": chat.SQL,
    "op9_suffix_dedup": suffix_dedup.SQL,
}
