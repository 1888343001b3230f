"""DuckDB SQL for the independent correctness oracle.

``VIEWS`` re-states the star-schema bindings of the test data in DuckDB SQL
(written independently of the Spark expressions in
``tripstar.sources.warehouse``); ``with_views`` prefixes a query body with
the CTEs it references. The raw tables (``lineitem``, ``orders`` …) are views
the checker registers.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "dim_zones": """
        SELECT CAST(n_nationkey AS INTEGER) AS zone_id,
               CAST(40.5 AS DOUBLE) + n_nationkey * CAST(0.02 AS DOUBLE) AS center_lat,
               CAST(-74.25 AS DOUBLE) + n_nationkey * CAST(0.02 AS DOUBLE) AS center_lon
        FROM nation WHERE n_nationkey < 24""",
    "dim_customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_name,
               CAST(DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS DATE) AS signup_date
        FROM customer""",
    "dim_drivers": """
        SELECT s_suppkey AS driver_id, s_name AS driver_name,
               CAST(DATE '1993-01-01' + CAST(s_suppkey % 365 AS INTEGER) AS DATE) AS join_date
        FROM supplier""",
    "dim_vehicles": """
        SELECT p_partkey AS vehicle_id, p_brand AS make, p_type AS model,
               CAST(1985 + p_size % 16 AS INTEGER) AS year
        FROM part""",
    "dim_payment_methods": """
        SELECT CAST(id AS INTEGER) AS payment_method_id, name AS method_name
        FROM (VALUES (1, 'Cash'), (2, 'Card'), (3, 'Wallet'), (4, 'Corporate')) v(id, name)""",
    "dim_agents": """
        SELECT s_suppkey AS agent_id, s_name AS agent_name, r_name AS region
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
                      JOIN region ON n_regionkey = r_regionkey
        WHERE s_suppkey < 9""",
    "fact_rides": """
        SELECT l_orderkey * 10 + l_linenumber AS ride_id,
               o_custkey AS customer_id,
               l_suppkey AS driver_id,
               CASE WHEN l_partkey % 97 <> 0 THEN l_partkey END AS vehicle_id,
               CAST(l_orderkey % 5 + 1 AS INTEGER) AS payment_method_id,
               CAST((o_custkey % 5) * (l_orderkey % 6) AS INTEGER) AS pickup_zone_id,
               CAST(l_partkey % 25 AS INTEGER) AS dropoff_zone_id,
               CASE WHEN l_orderkey % 211 <> 0
                    THEN l_shipdate + to_minutes(CAST((l_orderkey * 37 + l_linenumber * 53) % 1440 AS BIGINT))
               END AS ride_date,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS fare_amount,
               CASE WHEN l_discount <> 0 THEN CAST(l_quantity AS DECIMAL(12,2)) END AS distance_km,
               CAST(l_quantity * 2 + l_linenumber AS INTEGER) AS duration_minutes,
               CAST(l_tax * 100 AS DECIMAL(12,2)) AS tip_amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "dim_weather": """
        SELECT CAST(z AS INTEGER) AS zone_id, d AS date,
               CAST(((dayofyear(d) * 3 + z * 5) % 90) / 2 - 10 AS DOUBLE) AS temperature_2m,
               CAST((dayofyear(d) + z) % 4 AS DOUBLE) AS precipitation,
               CAST(CASE WHEN (dayofyear(d) + z) % 4 = 0 THEN 0 ELSE (dayofyear(d) + z) % 3 END AS DOUBLE) AS rain,
               CASE WHEN (dayofyear(d) + z) % 17 = 0 THEN 1.5 ELSE 0.0 END::DOUBLE AS snowfall,
               CAST((dayofyear(d) * 7 + z) % 101 AS DOUBLE) AS cloud_cover,
               CAST((dayofyear(d) + z * 3) % 30 AS DOUBLE) AS avg_wind_speed
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) days,
             (SELECT CAST(range AS INTEGER) AS z FROM range(0, 24)) zones
        WHERE (dayofyear(d) + z) % 11 <> 0""",
    "fact_support_tickets": """
        SELECT event_id AS ticket_id, user_id AS customer_id,
               CASE WHEN event_id % 13 <> 0 THEN event_id % 10 END AS agent_id,
               CASE event_type WHEN 'signup' THEN 'App' WHEN 'click' THEN 'Driver'
                    WHEN 'view' THEN 'Vehicle' WHEN 'purchase' THEN 'Fare' WHEN 'error' THEN 'Other' END AS issue_type,
               CASE event_id % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS priority,
               CASE event_id % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress'
                    WHEN 2 THEN 'Resolved' ELSE 'Closed' END AS status,
               ts AS opened_at,
               CASE WHEN event_id % 4 >= 2 THEN ts + to_minutes(event_id % 10080) END AS closed_at,
               CASE WHEN event_id % 4 >= 2 THEN CAST(event_id % 10080 AS INTEGER) END AS resolution_time_minutes,
               lk.ride_id, lk.driver_id
        FROM events LEFT JOIN (
            SELECT l_orderkey, min(l_orderkey * 10 + l_linenumber) AS ride_id, min(l_suppkey) AS driver_id
            FROM lineitem GROUP BY l_orderkey) lk ON event_id = lk.l_orderkey""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs (star views and ``extra`` ones) it references."""
    defs = dict(VIEWS)
    defs.update(extra or {})
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, view_sql in defs.items():
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(view_sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({defs[n].strip()})" for n in needed)
    body = body.strip()
    if re.match(r"(?i)^with\s", body):  # merge into the body's own WITH list
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
