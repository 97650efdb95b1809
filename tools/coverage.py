"""Print COVERAGE.md: survey rows, where they are built, and the queries that check them."""

import pathlib
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from barloom.catalog import ORACLE, QUERIES

ROWS = """
A1 A2 | sources/delimited.py, sources/bars.py read_bars_csv, tolerant | scanned_bar_files
A3 | sources/bars.py symbols_in | restricted_symbols
A4 A5 A6 | sources/delimited.py, sources/series.py | scanned_series
A7 A21 | sources/files.py read_predictions, read_evidence | collected_prediction_files collected_evidence_files
A8 | sources/files.py new_bars, append_bars | resumed_bars appended_bar_table
A9 | sources/payloads.py normalise_payload | normalised_payload
A10 | sources/payloads.py flatten_margins | margin_payloads
A11 | sources/payloads.py zip_parallel | parallel_array_payloads
A12 | sources/payloads.py name_bands | positional_bands
A13 G9 | sources/payloads.py daily_last, operators/splits.py keep_last | daily_last_by_date_text last_row_per_key
A14 | sources/files.py write_long_table | period_partition_roundtrip
A15 | sources/files.py csv_to_parquet | converted_csv_table
A16 A17 A18 | sources/files.py slim, write_csv, write_names, read_names | name_list_roundtrip test:test_stored_tables
A19 | operators/audits.py series_time_ranges | series_time_ranges
A20 | plans/fuse_experts.py expert_views | expert_views
B1 | functions/times.py epoch_ms, with_epoch_ms | epoch_units_by_row epoch_units_by_column
B2 B3 B4 | functions/times.py robust_timestamp, time_literal_ms | time_literals
B5 | functions/times.py floor_step | floored_steps
B6 | functions/times.py period_ms | period_lengths
B7 | functions/symbols.py | canonical_symbols
B8 B19 B20 | columns.py normalise_name, match_normalised, foreign_window_columns | normalised_column_names
B22 | columns.py family_key | family_dedup
B9 B11 B12 | functions/nulls.py | null_guards
B10 | operators/market.py regime_core | regime_core
B13 | functions/nulls.py narrow_for_sink | test:test_stored_tables
B14 | functions/times.py calendar_columns | calendar_cycle
B15 | sources/bars.py restrict | period_partition_roundtrip restricted_symbols
B16 | operators/rows.py feature_projection | feature_projection
B17 B18 | plans/experts.py, operators/rows.py resolution_report | feature_resolution
B21 | operators/rows.py prune_rows | prune_rows_any prune_rows_all prune_rows_thresh_k prune_rows_thresh_ratio
B23 | operators/joins.py fuse | fundamentals_only_fuse
B24 | operators/joins.py implied_price | implied_prices
B25 | operators/joins.py calibrate_scores | symbol_affine_scores
B26 | operators/market.py net_flow | net_flow
C1 C2 | operators/joins.py attach_series | series_attach
C3 | operators/joins.py assemble_series | series_assembly
C4 | operators/joins.py fuse, hold_last | leak_safe_fuse
C5 D6 | operators/joins.py broadcast_and_fill | broadcast_and_fill
C6 | operators/joins.py asof_join, next_close_asof | asof_purchase_view next_close_asof
C7 E55 | operators/market.py benchmark_returns, benchmark_beta | benchmark_beta
C8 K1 | operators/stacking.py stacking_table | stacking_table
C9 | operators/joins.py intersect_datasets | dataset_intersection
C10 | operators/joins.py modality_views | modality_row_counts
C11 | operators/joins.py pair_spread | pair_spread
D1 | operators/audits.py group_summary | group_summary
D2 D4 | operators/audits.py coverage | coverage_levels
D3 | operators/audits.py first_known_time | first_known_time
D5 | operators/stacking.py pivot_predictions | prediction_pivot
D7 | operators/stacking.py consistent_versions | version_consistency
D8 | operators/audits.py feature_moments | feature_moments
D9 | operators/audits.py column_health | column_health
D10 | operators/audits.py distribution | value_distribution
D11 | operators/screening.py correlation_pairs | top_linear_correlations
D12 | operators/audits.py early_null_rate | early_null_rate
D13 | operators/audits.py null_shape | null_shape
D14 | operators/audits.py time_column_scores | time_column_detection
D15 D16 | operators/scaling.py | target_standardisation
D17 | operators/joins.py winsorised_z | winsorised_z_global winsorised_z_by_symbol
D18 D19 | operators/joins.py with_rich_columns, with_rich_flags | rich_columns_and_flags
D20 | operators/audits.py quality_suggestion | quality_suggestion
D21 | operators/joins.py drop_sparse_rows | sparse_row_drop
D22 | operators/joins.py without_nulls | no_null_rows longest_complete_run
D23 | operators/market.py compounded_rate | compounded_rate
D24 | operators/audits.py group_counts | train_validation_counts
D25 | operators/audits.py symbol_hygiene | symbol_hygiene
D26 | sources/files.py file_report, schema_check | file_report
D27 | operators/audits.py dataset_summaries | dataset_summaries
E1 E28 E40 E54 | operators/indicators.py moving_averages | moving_averages
E2 E16 E39 | operators/indicators.py relative_strength | relative_strength
E3 E15 E38 | operators/indicators.py macd, macd_cross | macd_ppo
E4 | operators/indicators.py kdj | kdj
E5 E6 | operators/indicators.py momentum | momentum_volume_change
E7 E12 E34 | operators/indicators.py on_balance, finish_totals | on_balance_volume
E8 E36 | operators/indicators.py bollinger | bollinger
E9 E35 E37 E52 | operators/indicators.py true_range | true_range
E10 | operators/indicators.py commodity_channel | commodity_channel
E11 | operators/indicators.py adx | directional_movement
E13 E17 | operators/indicators.py channels | channels
E14 | operators/indicators.py keltner | keltner
E18 | operators/indicators.py tsi | true_strength
E19 | operators/indicators.py ichimoku | ichimoku
E20 E61 | operators/kernels.py parabolic_stop | parabolic_stop
E21 | operators/indicators.py supertrend | supertrend
E22 | operators/indicators.py heikin_ashi | heikin_ashi
E23 E24 | operators/indicators.py money_flow | money_flow
E25 | operators/indicators.py price_volume_corr | price_volume_corr
E26 | operators/indicators.py pivots | pivots
E27 | operators/indicators.py trend_lines | trend_lines
E29 E30 | operators/indicators.py volume_levels | volume_levels
E31 E33 E41 E42 | operators/indicators.py support_resistance | support_resistance
E32 | operators/market.py trend_agreement | trend_agreement
E43 E44 E45 E46 | operators/indicators.py regime_flags | regime_flags
E47 | operators/indicators.py squeeze | squeeze
E48 E49 E50 E51 | operators/indicators.py tail_risk | tail_risk
E53 | operators/indicators.py candles | candles
E56 | operators/market.py volume_profile | volume_profile
E57 E58 | operators/norms.py lag_guard, differences_and_slopes | lag_guard_and_slopes
E59 | operators/norms.py rolling_norms | rolling_norms
E60 | operators/kernels.py with_recursive | macd_ppo recursive_flat_stretch streamed_ema
E62 E63 | operators/norms.py lagged_standardise, operators/market.py taker_imbalance | taker_imbalance_z taker_imbalance_r taker_imbalance_m
E64 | operators/market.py open_interest_features | open_interest_features
E65 | operators/market.py regime_core | regime_core
E66 | operators/norms.py trim_warm_up | warm_up_trim
E67 | operators/outliers.py local_outliers (each column by itself; the joint score over all columns is not built) | local_outlier_factors
E68 | operators/rows.py fill_gaps, fill_counts | gap_filling gap_filling_counts
F1–F18 F20 F21 F22 | operators/labels.py with_labels | labels labels_forward_windows
F19 | operators/labels.py fund_flow_strength | fund_flow_strength
F23 | operators/labels.py drop_unlabelled | essential_label_rows
F24 | operators/labels.py label_fill | label_fill_report
F25 | operators/labels.py drop_incomplete_features | complete_feature_rows
F26 H4 G1 | operators/splits.py with_time_idx, operators/audits.py time_idx_breaks | merged_time_idx time_idx_breaks
G2 | operators/splits.py top_k_per_group | top_bars_per_group
G3 J18 | operators/evidence.py unified_core | unified_core
G4 J17 | operators/ranks.py, operators/evidence.py pair_metrics | pair_metrics
G5 | unionByName throughout | dataset_summaries
G6 G7 | operators/evidence.py common_features, union_targets | common_core union_targets
G8 | operators/evidence.py core_with_pinned, beyond_core | core_with_pinned beyond_core
G10 | operators/audits.py top_null_columns | top_null_columns
H1 H2 | operators/audits.py continuity, modal_steps | continuity_audit
H3 | operators/audits.py missing_points | missing_instants missing_instants_report
H5 | operators/audits.py leakage | leakage_audit
H6 | operators/audits.py truncation_breaks | truncation_check
I1 | operators/splits.py ratio_split | ratio_split
I2 I3 | operators/splits.py days_split | days_split
I4 | operators/splits.py rolling_folds | rolling_folds
I5 | operators/splits.py three_way_split | three_way_split
I6 | operators/splits.py edge_mask | embargo_purge_mask
I7 | operators/splits.py sample_cap | sample_cap test:test_splits_and_windows
I8 | operators/splits.py era_label | era_labels
I9 | operators/splits.py supervised_windows | supervised_windows
J1 J2 | operators/screening.py gate | coverage_variance_gate
J3 | operators/screening.py family_dedup | family_dedup
J4 | operators/screening.py clusters, representatives | strong_rank_correlations cluster_representatives
J5 | operators/screening.py vif_selection | vif_selection
J6 | operators/screening.py information_coefficient | information_coefficient
J7 | operators/screening.py binned_information | binned_information
J8 | operators/screening.py relevance | relevance_by_target_kind
J9 | operators/models.py tree_importance | tree_importance
J10 | operators/models.py shadow_test | shadow_test
J11 | operators/models.py linear_path | linear_path
J12 J13 | operators/evidence.py with_external, embedded_score | embedded_score
J14 | operators/models.py shuffle_permutation | shuffle_permutation
J15 | operators/models.py cyclic_permutation | cyclic_permutation
J16 | operators/evidence.py permutation_interval | permutation_interval
J19 | operators/evidence.py boost_features | boost_features
J20 | operators/evidence.py fuse_channels | channel_fusion
J21 J22 | operators/models.py subset_score, backward_elimination | backward_elimination
J23 | operators/models.py rolling_validation | rolling_validation
J24 | plans/screening.py screen | feature_screening
J25 | operators/screening.py impute_median | median_imputation feature_medians
K2 K7 | operators/stacking.py stack_features, operators/metrics.py clip_probability | equal_weight_baseline
K3 K20 | operators/models.py fit_stack, plans/stack.py | stack_model_report stack_report
K4 | operators/models.py fit_stack | stack_regression_report
K5 | operators/stacking.py equal_weight | equal_weight_baseline
K6 | operators/stacking.py best_single, single_scores | single_expert_scores baseline_stack_report
K8 | operators/metrics.py average_precision | average_precision
K9 | operators/metrics.py expected_calibration_error | calibration_error
K10 | operators/metrics.py calibration_bins | reliability_curve
K11 K13 | operators/metrics.py brier, classification, roc_auc | confusion_metrics roc_auc
K12 K14 | operators/metrics.py regression, interval_metrics | forecast_metrics
K15 | operators/metrics.py evaluation_report | evaluation_report
K16 | operators/models.py temperature | temperature_scaling
K17 K19 | operators/metrics.py class_weights, named_weights | class_balance_weights
K18 | operators/metrics.py gated_blend | gated_blend
L1 | streaming/bars.py stream_bars | streamed_hourly_bars
L2 | streaming/bars.py once_per_bar | streamed_bars_once
L3 L4 | streaming/bars.py stateful | streamed_ema streamed_parabolic_stop continued_ema continued_parabolic_stop
"""


def main() -> None:
    print("# Coverage\n\nSurvey rows, the code that builds them, and what checks them. Queries marked * have no SQL.\n")
    print("| Rows | Where (`barloom/`) | Checked by |\n| --- | --- | --- |")
    for line in ROWS.strip().splitlines():
        rows, where, checks = (x.strip() for x in line.split("|"))
        names = []
        for c in checks.split() if not checks.startswith("not") else [checks]:
            if c in QUERIES:
                names.append(f"`{c}`" + ("" if c in ORACLE else "*"))
            else:
                names.append(c.replace("test:", "") if c.startswith("test:") else c)
        print(f"| {rows} | {where} | {', '.join(names)} |")


if __name__ == "__main__":
    main()
