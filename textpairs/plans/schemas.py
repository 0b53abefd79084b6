"""Declared result types of the registered queries (generated by tools/type_check.py
--write from the Spark plans; the oracle SQL is cast to them)."""

SCHEMAS = {
    'a01_tsv_strict': [('guid', 'VARCHAR'), ('valid', 'BOOLEAN'), ('n_src', 'INTEGER'), ('n_trg', 'INTEGER'), ('src_text', 'VARCHAR'), ('trg_text', 'VARCHAR')],
    'a02_tsv_lenient': [('guid', 'VARCHAR'), ('valid', 'BOOLEAN'), ('n_src', 'INTEGER'), ('n_tgt', 'INTEGER'), ('src_text', 'VARCHAR'), ('tgt_text', 'VARCHAR')],
    'a03_jsonl_validate': [('guid', 'VARCHAR'), ('valid', 'BOOLEAN'), ('error', 'VARCHAR'), ('src', 'VARCHAR'), ('tgt', 'VARCHAR')],
    'a06_pair_classification': [('label', 'VARCHAR'), ('n', 'BIGINT'), ('n_chars', 'BIGINT')],
    'a07_classification': [('label', 'VARCHAR'), ('label_desc', 'VARCHAR'), ('n', 'BIGINT'), ('n_chars', 'BIGINT')],
    'a08_instructions': [('instruction_type', 'VARCHAR'), ('n', 'BIGINT'), ('n_input_chars', 'BIGINT')],
    'a12_inventory': [('file_name', 'VARCHAR'), ('n_rows', 'BIGINT')],
    'a14_error_buckets': [('guid', 'VARCHAR'), ('bucket', 'VARCHAR'), ('annotation', 'VARCHAR')],
    'a15_responses': [('guid', 'VARCHAR'), ('line', 'VARCHAR')],
    'a16_predictions': [('guid', 'VARCHAR'), ('input', 'VARCHAR'), ('prediction', 'VARCHAR'), ('type', 'VARCHAR')],
    'a18_run_log': [('event_type', 'VARCHAR'), ('n_rows', 'BIGINT'), ('best', 'DOUBLE')],
    'a19_report': [('pos', 'BIGINT'), ('cat', 'VARCHAR'), ('samples', 'BIGINT'), ('f1', 'DOUBLE'), ('format', 'BIGINT'), ('avg_f1', 'DOUBLE')],
    'a20_shards': [('n_rows', 'BIGINT'), ('within_cap', 'BOOLEAN')],
    'a21_fingerprint': [('n_rows', 'BIGINT'), ('checksum', 'BIGINT')],
    'b01_tsv_file_guid': [('guid', 'VARCHAR'), ('valid', 'BOOLEAN'), ('n_src', 'INTEGER'), ('trg_text', 'VARCHAR')],
    'b02_equal_length': [('lang', 'VARCHAR'), ('n_kept', 'BIGINT')],
    'b03_reject_waterfall': [('guid', 'VARCHAR'), ('reason', 'VARCHAR'), ('n_tok', 'INTEGER'), ('n_unk', 'INTEGER')],
    'b04_eval_waterfall': [('guid', 'VARCHAR'), ('reason', 'VARCHAR')],
    'b06_truncate': [('lang', 'VARCHAR'), ('n_cut', 'BIGINT'), ('n_tokens_kept', 'BIGINT')],
    'b07_filter_unk': [('lang', 'VARCHAR'), ('n_pairs', 'BIGINT'), ('n_without_unk', 'BIGINT')],
    'b12_missing_categories': [('category', 'VARCHAR')],
    'b13_after_step': [('shard', 'BIGINT'), ('n_rows', 'BIGINT')],
    'c03_label_ids': [('doc_id', 'BIGINT'), ('label', 'VARCHAR'), ('label_id', 'INTEGER')],
    'c05_align': [('status', 'VARCHAR'), ('n', 'BIGINT')],
    'c06_chat_prompts': [('item_id', 'BIGINT'), ('role0', 'VARCHAR'), ('content0', 'VARCHAR'), ('content1', 'VARCHAR')],
    'c07_near_positions': [('guid', 'VARCHAR'), ('n_near', 'INTEGER'), ('near_lo', 'INTEGER'), ('near_hi', 'INTEGER')],
    'c08_split_leaks': [('split_a', 'VARCHAR'), ('split_b', 'VARCHAR'), ('shared_pairs', 'BIGINT')],
    'd01_correction_eps': [('lang', 'VARCHAR'), ('samples', 'BIGINT'), ('positives', 'BIGINT'), ('negatives', 'BIGINT'), ('tp', 'BIGINT'), ('fp', 'BIGINT'), ('fn', 'BIGINT'), ('prd_pos', 'BIGINT'), ('precision', 'DOUBLE'), ('recall', 'DOUBLE'), ('f1', 'DOUBLE'), ('fpr', 'DOUBLE')],
    'd02_correction_guarded': [('lang', 'VARCHAR'), ('samples', 'BIGINT'), ('positives', 'BIGINT'), ('negatives', 'BIGINT'), ('tp', 'BIGINT'), ('fp', 'BIGINT'), ('fn', 'BIGINT'), ('wp', 'BIGINT'), ('prd_pos', 'BIGINT'), ('precision', 'DOUBLE'), ('recall', 'DOUBLE'), ('f1', 'DOUBLE'), ('fpr', 'DOUBLE'), ('wpr', 'DOUBLE')],
    'd03_correction_safe': [('lang', 'VARCHAR'), ('samples', 'BIGINT'), ('positives', 'BIGINT'), ('negatives', 'BIGINT'), ('tp', 'BIGINT'), ('fp', 'BIGINT'), ('fn', 'BIGINT'), ('wp', 'BIGINT'), ('prd_pos', 'BIGINT'), ('precision', 'DOUBLE'), ('recall', 'DOUBLE'), ('f1', 'DOUBLE'), ('fpr', 'DOUBLE')],
    'd04_correction_punct': [('lang', 'VARCHAR'), ('samples', 'BIGINT'), ('positives', 'BIGINT'), ('negatives', 'BIGINT'), ('tp', 'BIGINT'), ('fp', 'BIGINT'), ('fn', 'BIGINT'), ('wp', 'BIGINT'), ('prd_pos', 'BIGINT'), ('precision', 'DOUBLE'), ('recall', 'DOUBLE'), ('f1', 'DOUBLE'), ('fpr', 'DOUBLE')],
    'd05_detection': [('lang', 'VARCHAR'), ('samples', 'BIGINT'), ('positives', 'BIGINT'), ('negatives', 'BIGINT'), ('tp', 'BIGINT'), ('fp', 'BIGINT'), ('fn', 'BIGINT'), ('prd_pos', 'BIGINT'), ('precision', 'DOUBLE'), ('recall', 'DOUBLE'), ('f1', 'DOUBLE'), ('fpr', 'DOUBLE')],
    'd06_macro_average': [('rule', 'VARCHAR'), ('precision', 'DOUBLE'), ('recall', 'DOUBLE'), ('f1', 'DOUBLE'), ('fpr', 'DOUBLE')],
    'd07_accuracy': [('n', 'BIGINT'), ('correct', 'BIGINT'), ('accuracy', 'DOUBLE')],
    'd08_f1': [('n_classes', 'BIGINT'), ('f1_micro', 'DOUBLE'), ('f1_macro', 'DOUBLE'), ('f1_weighted', 'DOUBLE')],
    'd09_mcc': [('n', 'BIGINT'), ('mcc', 'DOUBLE')],
    'd10_spearman': [('n', 'BIGINT'), ('spearman', 'DOUBLE')],
    'd11_span_accuracy': [('n_spans', 'BIGINT'), ('n_exact', 'BIGINT'), ('n_tokens', 'BIGINT'), ('n_matched', 'BIGINT'), ('slacc', 'DOUBLE'), ('tlacc', 'DOUBLE')],
    'd12_perplexity': [('run', 'BIGINT'), ('n_steps', 'BIGINT'), ('mean_loss', 'DOUBLE')],
    'd13_audit': [('lang', 'VARCHAR'), ('total_records', 'BIGINT'), ('accepted', 'BIGINT'), ('invalid_records', 'BIGINT'), ('empty_records', 'BIGINT'), ('dropped_length_mismatch', 'BIGINT'), ('dropped_token_mismatch', 'BIGINT'), ('dropped_seq_length', 'BIGINT'), ('unknown_tokens', 'BIGINT'), ('total_tokens', 'BIGINT'), ('unk_rate', 'DOUBLE')],
    'd14_overflow': [('lang', 'VARCHAR'), ('n', 'BIGINT'), ('n_over', 'BIGINT'), ('pct_over', 'DOUBLE')],
    'd15_dropped': [('source', 'VARCHAR'), ('format', 'BIGINT'), ('length_mismatch', 'BIGINT'), ('token_mismatch', 'BIGINT'), ('seq_length', 'BIGINT')],
    'd16_seed_summary': [('event_type', 'VARCHAR'), ('n_seeds', 'BIGINT'), ('mean', 'DOUBLE'), ('std', 'DOUBLE'), ('best', 'DOUBLE'), ('best_seed', 'BIGINT')],
    'd17_project_precision': [('lang', 'VARCHAR'), ('ratio', 'DOUBLE'), ('proj_precision', 'DOUBLE'), ('proj_f1', 'DOUBLE')],
    'd18_confusion_report': [('kind', 'VARCHAR'), ('n_chars', 'BIGINT'), ('n_candidates', 'BIGINT'), ('n_duplicates', 'BIGINT'), ('n_self', 'BIGINT'), ('n_oov', 'BIGINT'), ('max_candidates', 'BIGINT')],
    'd19_errors_per_sentence': [('lang', 'VARCHAR'), ('n', 'BIGINT'), ('n_errors', 'BIGINT'), ('errors_per_sentence', 'DOUBLE')],
    'd19_noise_report': [('lang', 'VARCHAR'), ('n', 'BIGINT'), ('n_unchanged', 'BIGINT'), ('n_same_sound', 'BIGINT'), ('n_similar_sound', 'BIGINT'), ('n_shape', 'BIGINT'), ('n_word', 'BIGINT'), ('n_noised', 'BIGINT'), ('unchanged_share', 'DOUBLE'), ('same_sound_share', 'DOUBLE'), ('similar_sound_share', 'DOUBLE'), ('shape_share', 'DOUBLE'), ('word_share', 'DOUBLE')],
    'd21_error_pairs': [('wrong', 'VARCHAR'), ('right', 'VARCHAR'), ('n', 'BIGINT')],
    'e01_top_runs': [('run', 'BIGINT'), ('rank', 'BIGINT'), ('step', 'BIGINT'), ('value', 'DOUBLE')],
    'e02_last_runs': [('run', 'BIGINT'), ('rank', 'BIGINT'), ('step', 'BIGINT')],
    'e03_best_epoch': [('run', 'BIGINT'), ('best_metric', 'DOUBLE'), ('best_epoch', 'BIGINT')],
    'e04_select_config': [('event_type', 'VARCHAR'), ('dev_run', 'BIGINT'), ('dev_score', 'DOUBLE'), ('reported_test', 'DOUBLE'), ('leaky_run', 'BIGINT'), ('leaky_test', 'DOUBLE')],
    'e05_line_index': [('line_idx', 'BIGINT'), ('line', 'VARCHAR')],
    'e07_first_rejects': [('reason', 'VARCHAR'), ('rn', 'BIGINT'), ('guid', 'VARCHAR')],
    'e08_argmax': [('id', 'BIGINT'), ('pos', 'INTEGER'), ('pred', 'INTEGER')],
    'e09_loss_windows': [('run', 'BIGINT'), ('window', 'BIGINT'), ('n_steps', 'BIGINT'), ('mean_loss', 'DOUBLE')],
    'e10_first_diff': [('guid', 'VARCHAR'), ('first_diff', 'INTEGER')],
    'f01_sighan_union': [('year', 'VARCHAR'), ('valid', 'BOOLEAN'), ('n', 'BIGINT')],
    'f03_dedupe_confusion': [('kind', 'VARCHAR'), ('ch', 'VARCHAR'), ('idx', 'INTEGER'), ('cand', 'VARCHAR')],
    'g07_instruction_prompts': [('conv_id', 'BIGINT'), ('turn', 'BIGINT'), ('instruction_type', 'VARCHAR'), ('prompt', 'VARCHAR'), ('input_line', 'VARCHAR'), ('last_line', 'VARCHAR')],
    'g09_strip_prefix': [('conv_id', 'BIGINT'), ('turn', 'BIGINT'), ('difference', 'VARCHAR'), ('stripped', 'VARCHAR')],
    'g10_arrows': [('guid', 'VARCHAR'), ('interleaved', 'VARCHAR'), ('recovered', 'VARCHAR')],
    'g14_decode': [('guid', 'VARCHAR'), ('at_mask', 'VARCHAR'), ('by_offset', 'VARCHAR')],
    'g16_anchor_removal': [('guid', 'VARCHAR'), ('after_anchor', 'VARCHAR'), ('before_len', 'INTEGER')],
    'g17_causal_split': [('guid', 'VARCHAR'), ('prompt_len', 'INTEGER'), ('target', 'VARCHAR')],
    'h01_noise': [('guid', 'VARCHAR'), ('noise_pos', 'INTEGER'), ('noise_kind', 'VARCHAR'), ('noise_from', 'VARCHAR'), ('noise_to', 'VARCHAR'), ('src', 'VARCHAR')],
    'h02_near_error': [('guid', 'VARCHAR'), ('noise_pos', 'INTEGER'), ('noisy', 'VARCHAR')],
    'h03_h04_masked_arrays': [('mode', 'VARCHAR'), ('guid', 'VARCHAR'), ('input_ids', 'VARCHAR'), ('labels', 'VARCHAR')],
    'h05_any_mask_report': [('lang', 'VARCHAR'), ('n_rows', 'BIGINT'), ('n_candidates', 'BIGINT'), ('n_masked', 'BIGINT'), ('mask_rate', 'DOUBLE')],
    'h06_h08_masks': [('lang', 'VARCHAR'), ('n_rows', 'BIGINT'), ('n_candidates', 'BIGINT'), ('n_masked', 'BIGINT'), ('n_joint', 'BIGINT'), ('n_gated', 'BIGINT')],
    'h10_mask_report': [('lang', 'VARCHAR'), ('n_rows', 'BIGINT'), ('n_candidates', 'BIGINT'), ('n_masked', 'BIGINT'), ('mask_rate', 'DOUBLE')],
    'i01_layout': [('guid', 'VARCHAR'), ('input_ids', 'VARCHAR'), ('labels', 'VARCHAR'), ('n_attended', 'INTEGER'), ('n_mft_candidates', 'INTEGER')],
    'i02_batch_layout': [('guid', 'VARCHAR'), ('src_ids', 'VARCHAR'), ('trg_ids', 'VARCHAR'), ('trg_ref_ids', 'VARCHAR'), ('loss_labels', 'VARCHAR')],
    'i03_tagging': [('guid', 'VARCHAR'), ('src_ids', 'VARCHAR'), ('trg_ids', 'VARCHAR')],
    'i04_noisy_tagging': [('guid', 'VARCHAR'), ('src_ids', 'VARCHAR'), ('trg_ids', 'VARCHAR'), ('trg_ref_ids', 'VARCHAR')],
    'i05_prompted_layout': [('guid', 'VARCHAR'), ('fits', 'BOOLEAN'), ('src_ids', 'VARCHAR'), ('trg_ids', 'VARCHAR'), ('trg_ref_ids', 'VARCHAR'), ('block_flag', 'VARCHAR')],
    'i06_classification': [('doc_id', 'BIGINT'), ('label_id', 'INTEGER'), ('src_ids', 'VARCHAR'), ('token_type_ids', 'VARCHAR'), ('trg_ids', 'VARCHAR'), ('task_id', 'INTEGER'), ('n_attended', 'INTEGER')],
    'i07_prompted_classification': [('doc_id', 'BIGINT'), ('label_word_ids', 'VARCHAR'), ('src_ids', 'VARCHAR'), ('prompt_mask', 'VARCHAR'), ('active_bits', 'VARCHAR'), ('trg_ids', 'VARCHAR')],
    'i08_causal': [('guid', 'VARCHAR'), ('input_ids', 'VARCHAR'), ('labels', 'VARCHAR'), ('regu_src', 'VARCHAR'), ('target_ref', 'VARCHAR')],
    'i09_instruction_mask': [('style', 'VARCHAR'), ('conv_id', 'BIGINT'), ('turn', 'BIGINT'), ('overflow', 'INTEGER'), ('labels', 'VARCHAR'), ('src_ref', 'VARCHAR'), ('input_ids', 'VARCHAR')],
    'i10_eval_records': [('guid', 'VARCHAR'), ('n_src', 'INTEGER'), ('n_trg', 'INTEGER'), ('n_attended', 'INTEGER'), ('pred_sum', 'BIGINT'), ('src_text', 'VARCHAR'), ('trg_text', 'VARCHAR')],
    'i11_mono_vectorise': [('guid', 'VARCHAR'), ('src_ids', 'VARCHAR'), ('trg_ids', 'VARCHAR'), ('trg_ref_ids', 'VARCHAR')],
    'j03_cycles': [('cycle', 'BIGINT'), ('n', 'BIGINT'), ('n_changed', 'BIGINT'), ('n_noised', 'BIGINT')],
    'j04_batches': [('guid', 'VARCHAR'), ('shard', 'BIGINT'), ('batch_id', 'BIGINT'), ('pos_in_shard', 'BIGINT')],
    'j06_rotate_mix': [('step', 'BIGINT'), ('task_no', 'INTEGER'), ('n', 'BIGINT')],
    'j07_split_dev': [('lang', 'VARCHAR'), ('split', 'VARCHAR'), ('n', 'BIGINT')],
    'j09_mix_report': [('win', 'BIGINT'), ('task_no', 'INTEGER'), ('n', 'BIGINT'), ('share', 'DOUBLE')],
    'k01_feature_stream': [('input_ids', 'VARCHAR'), ('labels', 'VARCHAR')],
    'k02_route_restart': [('reason', 'VARCHAR'), ('n', 'BIGINT')],
    'k03_stream_stats': [('reason', 'VARCHAR'), ('n', 'BIGINT'), ('n_tok', 'BIGINT'), ('n_unk', 'BIGINT')],
    'k06_stream_eval': [('lang', 'VARCHAR'), ('samples', 'BIGINT'), ('positives', 'BIGINT'), ('negatives', 'BIGINT'), ('tp', 'BIGINT'), ('fp', 'BIGINT'), ('fn', 'BIGINT'), ('wp', 'BIGINT'), ('prd_pos', 'BIGINT'), ('precision', 'DOUBLE'), ('recall', 'DOUBLE'), ('f1', 'DOUBLE'), ('fpr', 'DOUBLE')],
    'l01_label_product': [('id', 'BIGINT'), ('pred_label', 'INTEGER')],
    'l02_label_sum': [('id', 'BIGINT'), ('pred_label', 'INTEGER')],
    'l03_decode': [('id', 'BIGINT'), ('tokens', 'VARCHAR')],
    'l04_copy_mix': [('id', 'BIGINT'), ('pos', 'INTEGER'), ('pred', 'INTEGER')],
    'm01_corrector_hook': [('lang', 'VARCHAR'), ('samples', 'BIGINT'), ('positives', 'BIGINT'), ('negatives', 'BIGINT'), ('tp', 'BIGINT'), ('fp', 'BIGINT'), ('fn', 'BIGINT'), ('wp', 'BIGINT'), ('prd_pos', 'BIGINT'), ('precision', 'DOUBLE'), ('recall', 'DOUBLE'), ('f1', 'DOUBLE'), ('fpr', 'DOUBLE')],
    'm02_tokenizer_hook': [('lang', 'VARCHAR'), ('n_lines', 'BIGINT'), ('n_tokens', 'BIGINT')],
}
