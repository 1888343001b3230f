"""Binds query ids to operators."""

from __future__ import annotations

from tripstar.catalog import register
from tripstar.operators import questions as qs

for _name in [
    "q01_top_pickup_zones", "q01_top_dropoff_zones", "q02_demand_by_weekday", "q03_avg_fare_by_zone",
    "q04_trip_metrics", "q04_trip_sample", "q05_vehicle_revenue", "q06_weather_demand",
    "q06_temperature_bins", "q07_weather_trip_metrics", "q08_issue_types", "q09_resolution_by_issue",
    "q09_resolution_by_priority", "q10_agent_performance", "rev_overall", "rev_by_driver", "rev_daily",
    "agg_demand_grain", "agg_customer_ticket_profile", "agg_zone_risk",
    "q_demand_by_hour", "q_demand_by_month", "q_avg_tip_by_zone", "q_weather_duration_corr",
    "q_issue_by_location", "q_driver_complaints", "q_zone_hour_demand", "topk_10", "topk_15", "sort_groups",
]:
    register(_name)(getattr(qs, _name))

from tripstar.operators import views as vw  # noqa: E402

for _name in [
    "src_rides_star", "src_weather_zone", "src_tickets_agents", "src_fare_training", "src_demand_training",
    "proj_calendar_names", "proj_calendar_parts", "proj_date_only", "proj_tenure_days", "proj_vehicle_age",
    "proj_avg_speed", "proj_zone_distance", "proj_weather_impute", "proj_location_impute",
    "proj_weather_severity", "proj_time_flags", "proj_weather_condition", "proj_numeric_coerce",
    "proj_feature_vector_fare", "proj_feature_vector_demand", "proj_demand_level", "proj_demand_rounded",
    "proj_minutes_to_hours", "proj_vehicle_label", "proj_trip_factors", "proj_demand_factors", "proj_calendar_parts_monday",
    "flt_ride_date", "flt_weather_date", "flt_fare_valid", "flt_dropna_fare", "flt_min_rides",
    "flt_temp_present", "flt_slice",
    "join_zones_role", "join_vehicle_payment", "join_tenure", "join_weather_zone_inner", "join_agents",
    "join_weather_day", "join_weather_exact", "join_calendar_reindex",
]:
    register(_name)(getattr(vw, _name))

from tripstar.operators import loading as ld  # noqa: E402

for _name in [
    "ingest_customers", "ingest_drivers", "ingest_vehicles", "ingest_tickets", "ingest_rides_full",
    "src_csv_rides", "ingest_rides_batch", "sink_surrogate_ids",
    "etl_clean_validate", "etl_unit_convert", "etl_zones_kmeans", "etl_zone_assign", "etl_weather_enrich",
    "etl_resolution_time", "etl_dim_build", "etl_dim_customers", "etl_dim_drivers", "etl_fact_tickets", "etl_warehouse", "etl_fare_training", "etl_fact_build", "sink_warehouse_load", "src_weather_files",
    "ingest_stream_validate", "flt_required",
]:
    register(_name)(getattr(ld, _name))

from tripstar.ml import queries as mlq  # noqa: E402

for _name in [
    "ml_split", "ml_scale", "ml_linear", "ml_metrics", "ml_mape", "ml_cv", "ml_selection_score",
    "ml_score_backfill", "ml_select_best", "ml_metrics_table",
    "ml_normal_equations", "ml_linear_all_features", "ml_ridge", "ml_cv_linear_models", "ml_random_forest", "ml_gbt", "ml_gbt_subsampled", "ml_train_all", "ml_duration",
    "ml_score_fare", "ml_score_demand", "ml_segment_customers",
    "ml_compiled_models", "sink_models", "src_models", "sink_metrics_json", "sink_metrics_csv", "sink_best_info", "sink_risk_zones", "sink_segments",
]:
    register(_name)(getattr(mlq, _name))
