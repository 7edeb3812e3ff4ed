import __spark_entry__ as entry

SURVEYED = "detect_email detect_ip detect_phone detect_secret detect_card_luhn detect_url dictionary_hits dictionary_offsets truth_explode leak_predicate detection_rate miss_rate recall_by_lang recall_by_type recall_grouping_sets recall_strict recall_pivot solution_compare fp_clean_entities fp_clean_docs fp_distinct_originals prf_global prf_by_lang greedy_match fn_items fp_items overlap_exact overlap_folded label_quality label_text_join label_left_default carrier_multimodal carrier_tool carrier_nested flatten_messages carrier_parity carrier_regressions tool_leak tool_leak_ascii mm_leak tool_protection roundtrip_restore placeholder_mapping even_sample last_wins_dedup first_wins_lookup token_estimate latency_stats latency_by_group lang_config_applicability corpus_counts corpus_union label_mapping must_preserve detect_iban detect_ssn detect_nhs detect_date label_types quality_sample detect_allowed carrier_policies flat_only_regressions carrier_roundtrips native_summary multimodal_text lang_defaults dictionary_merge set_equality shown_recall file_last_wins conversation_mapping conversation_redaction secret_quality detect_cues tree_parity language_keys".split()


def test_surveyed_queries_have_sql():
    assert set(SURVEYED) <= entry.queries().keys() and set(SURVEYED) <= entry.oracle_sql().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"lang", "type", "total", "caught", "recall"}
