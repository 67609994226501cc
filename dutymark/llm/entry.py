"""Queries of the training-data operators, and DuckDB SQL where it can express them."""

from dutymark.llm import centroids, chat, classifier, decontaminate, jaccard, language, lm_score, mixing, negatives, pii, quality_rules, substrings, warc

QUERIES = {
    "op3_lm_scoring": lm_score.op3_lm_scoring,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op1_warc": warc.op1_warc,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_pii": pii.op7_pii,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_quality_classifier": classifier.op9_quality_classifier,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_language_id": language.op11_language_id,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}
ORACLE_SQL = {"op1_warc": warc.OP1_SQL, "op5_mixing": mixing.OP5_SQL, "op8_chat_formatting": chat.OP8_SQL, "op12_hard_negatives": negatives.OP12_SQL, "op13_centroid_clustering": centroids.OP13_SQL}
