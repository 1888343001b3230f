"""Hand-made star tables for edge-case tests."""

import datetime as dt
from decimal import Decimal

from tripstar.sources.warehouse import Warehouse

RIDES = ("ride_id long, customer_id long, driver_id long, vehicle_id long, payment_method_id int, "
         "pickup_zone_id int, dropoff_zone_id int, ride_date timestamp_ntz, fare_amount decimal(12,2), "
         "distance_km decimal(12,2), duration_minutes int, tip_amount decimal(12,2)")
ZONES = "zone_id int, center_lat double, center_lon double"
WEATHER = ("zone_id int, date date, temperature_2m double, precipitation double, rain double, snowfall double, "
           "cloud_cover double, avg_wind_speed double")
TICKETS = ("ticket_id long, customer_id long, agent_id long, issue_type string, priority string, status string, "
           "opened_at timestamp_ntz, closed_at timestamp_ntz, resolution_time_minutes int, ride_id long, "
           "driver_id long")
AGENTS = "agent_id long, agent_name string, region string"
VEHICLES = "vehicle_id long, make string, model string, year int"
PAYMENTS = "payment_method_id int, method_name string"
CUSTOMERS = "customer_id long, customer_name string, signup_date date"
DRIVERS = "driver_id long, driver_name string, join_date date"


def ride(rid, zone=1, when=dt.datetime(2024, 1, 1, 8, 0), fare="10.00", dist="5.00", dur=10, vehicle=1,
         driver=1, customer=1, dropoff=2, payment=1, tip="1.00"):
    d = lambda v: None if v is None else Decimal(v)
    return (rid, customer, driver, vehicle, payment, zone, dropoff, when, d(fare), d(dist), dur, d(tip))


def warehouse(spark, rides=(), zones=((1, 40.5, -74.0), (2, 40.6, -74.1)), weather=(), tickets=(),
              agents=(), vehicles=((1, "Make", "Model", 2015),), payments=((1, "Cash"),),
              customers=(), drivers=()):
    frames = {
        "fact_rides": spark.createDataFrame(list(rides), RIDES),
        "dim_zones": spark.createDataFrame(list(zones), ZONES),
        "dim_weather": spark.createDataFrame(list(weather), WEATHER),
        "fact_support_tickets": spark.createDataFrame(list(tickets), TICKETS),
        "dim_agents": spark.createDataFrame(list(agents), AGENTS),
        "dim_vehicles": spark.createDataFrame(list(vehicles), VEHICLES),
        "dim_payment_methods": spark.createDataFrame(list(payments), PAYMENTS),
        "dim_customers": spark.createDataFrame(list(customers), CUSTOMERS),
        "dim_drivers": spark.createDataFrame(list(drivers), DRIVERS),
    }
    return Warehouse.from_frames(spark, frames)
