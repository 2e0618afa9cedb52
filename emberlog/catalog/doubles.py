"""The double columns of each query's result."""

from __future__ import annotations

DOUBLES = {
    "store_latest": ["f"],
    "store_vectors": ["score"],
    "store_runs": ["value"],
    "stream_anomaly": ["score"],
    "training_set_asof": ["value"],
    "ts_backtest_buy_and_hold": ["total_return", "max_drawdown"],
    "kv_latest": ["f"],
    "kv_history": ["f"],
    "kv_live_history": ["total"],
    "kv_float_history": ["f"],
    "kv_history_tensor": ["first", "last"],
    "kv_compact": ["f"],
    "kv_point_read": ["f"],
    "kv_typed_cast": ["as_f64"],
    "delta_encode": ["stored"],
    "delta_roundtrip": ["decoded"],
    "ts_rolling": ["roll_mean", "roll_std", "roll_min", "roll_max", "roll_range", "roll_median"],
    "ts_rolling_hot": ["roll_mean", "roll_max"],
    "ts_lag_hot": ["lag_1", "lag_10"],
    "ts_drawdown_hot": ["max_drawdown"],
    "ts_ma_cross_hot": ["ma_short", "ma_long"],
    "ts_rolling_padded": ["roll_mean"],
    "ts_diff": ["diff1", "diff2", "abs_diff"],
    "ts_lag": ["lag_1", "lagdiff_1", "lag_5", "lagdiff_5", "lag_10", "lagdiff_10", "lag_20", "lagdiff_20"],
    "ts_last_n": ["f"],
    "ts_stats": ["mean", "std", "min", "max"],
    "ts_describe": ["mean", "std", "min", "p25", "p50", "p75", "max"],
    "ts_trend": ["trend"],
    "ts_zscore_anomaly": ["f", "z"],
    "ts_normalize": ["z"],
    "ts_denormalize": ["value"],
    "ts_drift": ["max_step", "mean_shift"],
    "ts_downsample": ["mean"],
    "ts_resample_hour": ["mean", "min", "max"],
    "ts_resample_filled": ["mean"],
    "ts_between_time": ["f"],
    "ts_time_range": ["f"],
    "ts_share_above": ["percent"],
    "ts_corr": ["corr"],
    "ts_zip": ["click", "view", "error", "length"],
    "ts_sequences": ["x_sum", "y"],
    "ts_bollinger": ["mid", "sigma"],
    "ts_ma_cross": ["ma_short", "ma_long"],
    "ts_drawdown": ["max_drawdown"],
    "ts_forecast_errors": ["mse", "rmse", "mae"],
    "ts_latency": ["p50", "p95", "p99"],
    "ts_threshold_p99": ["f"],
    "ts_hourly_rollup": ["total"],
    "wide_pivot": ["click", "error", "view"],
    "knn_cosine": ["score"],
    "knn_euclidean": ["score"],
    "knn_dot": ["score"],
    "knn_batch": ["score"],
    "knn_first_write_wins": ["score"],
    "knn_last_write_wins": ["score"],
    "vec_similarity_desc": ["similarity"],
    "vec_centroid_by_label": ["mean"],
    "vec_norms": ["norm"],
    "hot_cold_merge": ["score"],
    "sparse_index_stats": ["avg_doc_length"],
    "sparse_norms": ["l1", "l2"],
    "sparse_named_topk": ["score"],
    "sparse_delete": ["avg_doc_length"],
    "lex_index_stats": ["avg_doc_length"],
    "lex_topk": ["score"],
    "lex_topk_batch": ["score"],
    "rrf_hybrid": ["score"],
    "hybrid_dense_mode": ["score"],
    "hybrid_sparse_mode": ["score"],
    "retrieval_eval": ["recall_at_k", "mrr"],
    "ckpt_best": ["metric"],
    "ckpt_best_lowest": ["metric"],
    "runs_sort_metric_nulls_first": ["metric"],
    "runs_latest_metric": ["latest", "min", "max", "mean"],
    "metric_steps": ["value"],
    "exp_session_stats": ["total_reward", "mean_reward"],
    "exp_episode_stats": ["mean_length", "mean_reward", "least", "most"],
    "features_asof": ["value"],
    "features_latest": ["value"],
    "asof_events": ["error_value"],
    "training_set": ["credit", "open_fares", "fare_mean"],
    "cross_entity": ["credit", "charge_pct"],
    "tensor_elements": ["value"],
    "tensor_history": ["value"],
    "tensor_assemble": ["first", "last", "total"],
    "tensor_put": ["value"],
    "tensor_roundtrip": ["x"],
    "tensor_batches": ["total"],
    "tensor_transform": ["value"],
    "agg_category": ["avg_quantity", "avg_discount", "revenue"],
    "agg_pricing_summary": ["sum_disc", "sum_charge"],
    "agg_rollup": ["total"],
    "join_nation_revenue": ["revenue"],
    "top_limit": ["o_totalprice"],
    "stream_hot_tier": ["score"],
    "stream_tumbling": ["total"],
    "stream_sliding": ["total"],
    "stream_rolling_state": ["mean", "low", "high"],
    "stream_latest_upsert": ["value"],
    "io_jsonl_lines": ["number"],
    "io_csv_roundtrip": ["f"],
    "io_parquet_roundtrip": ["f"],
    "io_jsonl_roundtrip": ["f"],
    "io_from_frame": ["f"],
}
