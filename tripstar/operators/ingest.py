"""Ingest contracts for the operational tables, applied to whole batches.

Each ``validate_*`` returns the batch with defaults applied and a
``reject_reason`` column (null for valid rows, else the ``;``-joined names of
the failed rules). ``split`` turns that into the valid and quarantine sides;
``append`` writes both sides idempotently per load and reports counts
through an ``Observation`` (no extra pass over the data).

Where a form inserts one record and any bad value aborts, a batch here keeps
its good rows and quarantines the bad ones with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Fixed values of the ingest contracts.
ISSUE_TYPES = ["Driver", "Vehicle", "Fare", "App", "Other"]
TICKET_STATUSES = ["Open", "In Progress", "Resolved", "Closed"]
PRIORITIES = ["Low", "Medium", "High"]
VEHICLE_TYPES = ["Standard", "Premium", "SUV", "Luxury"]
VEHICLE_YEAR_MIN, VEHICLE_YEAR_MAX = 1990, 2025
RIDE_DEFAULTS = {
    "vendor_id": 1, "passenger_count": 1, "extra": 0.0, "mta_tax": 0.0, "tip_amount": 0.0,
    "tolls_amount": 0.0, "improvement_surcharge": 0.0, "ratecode_id": 1, "store_and_fwd_flag": "N",
    "ride_status": "Completed",
}
TICKET_DEFAULTS = {"status": "Open", "priority": "Medium"}


def blank(c: str) -> Column:
    """Null or only whitespace."""
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def with_reason(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reject_reason``: the names of the rules whose *failure* condition holds."""
    parts = [F.when(cond, F.lit(name)) for name, cond in rules.items()]
    reason = F.concat_ws(";", *parts)
    return df.withColumn("reject_reason", F.when(reason != "", reason))


def required(*cols: str) -> dict[str, Column]:
    return {f"missing_{c}": blank(c) for c in cols}


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = validated.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = validated.filter(F.col("reject_reason").isNotNull())
    return ok, bad


def append(validated: DataFrame, valid_path: str, quarantine_path: str, load_id: str,
           fmt: str = "parquet") -> dict:
    """Write both sides of a validated batch under its ``load_id``; returns observed row counts.

    Each side is partitioned by ``load_id`` and written with dynamic partition
    overwrite, so re-running a load (after a lost executor or a failed job)
    replaces that load's rows instead of appending them twice; other loads are
    untouched. Counts come from ``Observation`` metrics collected while writing.
    """
    obs_ok, obs_bad = Observation("valid"), Observation("quarantined")
    ok, bad = split(validated)
    for side, obs, path in ((ok, obs_ok, valid_path), (bad, obs_bad, quarantine_path)):
        (side.withColumn("load_id", F.lit(load_id)).observe(obs, F.count(F.lit(1)).alias("rows"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("load_id").format(fmt).save(path))
    return {"valid": obs_ok.get["rows"], "quarantined": obs_bad.get["rows"]}


# ---------------------------------------------------------------- per table
def validate_customers(df: DataFrame) -> DataFrame:
    return with_reason(df, required("first_name", "last_name", "email", "phone"))


def validate_drivers(df: DataFrame) -> DataFrame:
    out = df.withColumn("is_active", F.coalesce(F.col("is_active"), F.lit(True)))
    return with_reason(out, required("first_name", "last_name", "license_number", "phone"))


def validate_vehicles(df: DataFrame) -> DataFrame:
    out = df.withColumn("is_active", F.coalesce(F.col("is_active"), F.lit(True)))
    rules = required("license_plate", "make", "model", "color")
    rules["year_out_of_range"] = (F.col("year").isNull()
                                  | ~F.col("year").between(VEHICLE_YEAR_MIN, VEHICLE_YEAR_MAX))
    rules["bad_vehicle_type"] = F.col("vehicle_type").isNull() | ~F.col("vehicle_type").isin(VEHICLE_TYPES)
    return with_reason(out, rules)


def validate_tickets(df: DataFrame) -> DataFrame:
    out = df.withColumns({
        "driver_id": F.nullif(F.col("driver_id"), F.lit(0)),
        "assigned_agent_id": F.nullif(F.col("assigned_agent_id"), F.lit(0)),
        "status": F.coalesce(F.col("status"), F.lit(TICKET_DEFAULTS["status"])),
        "priority": F.coalesce(F.col("priority"), F.lit(TICKET_DEFAULTS["priority"])),
    })
    rules = required("ride_id", "customer_id", "description")
    rules["bad_issue_type"] = F.col("issue_type").isNull() | ~F.col("issue_type").isin(ISSUE_TYPES)
    rules["bad_status"] = ~F.col("status").isin(TICKET_STATUSES)
    rules["bad_priority"] = ~F.col("priority").isin(PRIORITIES)
    return with_reason(out, rules)


RIDE_REQUIRED = ["customer_id", "driver_id", "vehicle_id", "pickup_datetime", "trip_distance",
                 "pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude",
                 "fare_amount", "total_amount", "payment_method_id"]


def validate_rides_full(df: DataFrame) -> DataFrame:
    """The 23-column ride record: optional fields take their defaults."""
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
                          for c, v in RIDE_DEFAULTS.items() if c in df.columns})
    return with_reason(out, required(*RIDE_REQUIRED))


# Types of the 15 columns of a batch ride upload.
RIDE_BATCH_TYPES = {
    "customer_id": "int", "driver_id": "int", "vehicle_id": "int",
    "pickup_datetime": "timestamp_ntz", "dropoff_datetime": "timestamp_ntz", "passenger_count": "int",
    "trip_distance": "double", "pickup_longitude": "double", "pickup_latitude": "double",
    "dropoff_longitude": "double", "dropoff_latitude": "double", "fare_amount": "double",
    "total_amount": "double", "payment_method_id": "int", "ride_status": "string",
}


def typed_cell(text: Column, typ: str) -> Column:
    """A text cell as ``typ``, null if it can't be read so. Whole numbers may be written with a fraction of zero
    (``7.0``), as spreadsheets write an integer column that has gaps; NaN is no number."""
    if typ == "int":
        number = text.try_cast("double")
        whole = (number == F.floor(number)) & number.between(-(2 ** 31), 2 ** 31 - 1)
        return F.coalesce(text.try_cast("int"), F.when(whole, number.try_cast("int")))
    if typ == "double":
        number = text.try_cast("double")
        return F.when(~F.isnan(number), number)
    return text.try_cast(typ) if typ != "string" else text


def validate_rides_batch(df: DataFrame) -> DataFrame:
    """Type every cell of an uploaded ride batch; unparseable cells quarantine the row.

    Missing ``passenger_count`` becomes 1 and missing ``ride_status``
    'Completed' (both for absent cells and for an absent column).
    """
    cols = {}
    bad_cells = {}
    for c, typ in RIDE_BATCH_TYPES.items():
        raw = F.col(c) if c in df.columns else F.lit(None)
        text = F.trim(raw.cast("string"))
        typed = typed_cell(text, typ)
        cols[c] = typed
        if typ != "string":
            bad_cells[f"bad_{c}"] = text.isNotNull() & (text != "") & typed.isNull()
    cols["passenger_count"] = F.coalesce(cols["passenger_count"], F.lit(1))
    cols["ride_status"] = F.coalesce(F.when(cols["ride_status"] != "", cols["ride_status"]),
                                     F.lit(RIDE_DEFAULTS["ride_status"]))
    out = df.select(*[v.alias(k) for k, v in cols.items()],
                    *[v.alias(f"__{k}") for k, v in bad_cells.items()])
    rules = {k: F.col(f"__{k}") for k in bad_cells}
    rules.update({f"missing_{c}": F.col(c).isNull() for c in RIDE_REQUIRED})
    return with_reason(out, rules).drop(*[f"__{k}" for k in bad_cells])
