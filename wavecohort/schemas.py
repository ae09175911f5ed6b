"""Table layouts of the collection store, and reconciliation of older layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

# Table and column names of the stored data model.
DDL = {
    "uploads": (
        "phone_session_uuid string, uploader_phone_id string, device_name string, "
        "opened_at double, completed_at double, status string, files_json string, "
        "convert_stats_json string"
    ),
    "cuff_readings": (
        "reading_id string, taken_at string, sys int, dia int, pulse int, ihb boolean, "
        "mov boolean, device string, uploader_phone_id string, uploaded_at double, "
        "phone_read_at string, clock_offset_s double, clock_offset_uncertainty_s double, "
        "clock_valid boolean, clock_suspect boolean, slot int"
    ),
    "sessions": (
        "id bigint, session_uuid string, start_time double, end_time double, "
        "device_name string, device_address string, settings string, "
        "epoch_offset_ns bigint, rotation_period_minutes int"
    ),
    "notes": "session_id bigint, ts double, note string",
    "ppg": (
        "session_id bigint, timestamp_ns bigint, ppg0 bigint, ppg1 bigint, ppg2 bigint, "
        "ambient bigint"
    ),
    "acc": "session_id bigint, timestamp_ns bigint, x double, y double, z double",
    "gyro": "session_id bigint, timestamp_ns bigint, x double, y double, z double",
    "segments": "session_uuid string, event string, segment_id bigint, ts double",
    "derived_ppg_minute": (
        "ts double, label string, hr_ppg double, sqi double, perfusion double, "
        "acc_motion double, n_ppg int"
    ),
}

# One bundle manifest, and the wire layout of one uploaded reading.
MANIFEST_DDL = (
    "session_uuid string, started_at double, ended_at double, device_name string, "
    "settings map<string,int>, epoch_offset_ns bigint, rotation_period_minutes int, "
    "rop_files array<string>"
)
READING_WIRE_DDL = (
    "id string, ts string, sys int, dia int, pulse int, ihb boolean, mov boolean, "
    "device string, phone_read_at string, clock_offset_s double, "
    "clock_offset_uncertainty_s double, clock_valid boolean, clock_suspect boolean, slot int"
)
STATS_DDL = (
    "samples_per_sensor map<string,bigint>, segments bigint, notes bigint, "
    "rop_files bigint, db_session_id bigint"
)

#: Provenance columns: filled once, never overwritten.
FILL_ONCE = (
    "phone_read_at",
    "clock_offset_s",
    "clock_offset_uncertainty_s",
    "clock_valid",
    "clock_suspect",
    "slot",
)


#: A sample of a sensor without a table of its own: its fields by name, as numbers where they are, and as sent.
FIELDS_DDL = "array<struct<name:string,value:double,text:string>>"
SAMPLE_DDL = f"session_id bigint, sensor string, timestamp_ns bigint, fields {FIELDS_DDL}"


def sample_schema(sensor: str) -> StructType:
    """Layout of a sensor's samples: its own, or that of any sensor."""
    return StructType.fromDDL(DDL.get(sensor, SAMPLE_DDL))


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


def reconcile(df: DataFrame, schema: StructType) -> DataFrame:
    """Add the columns ``df`` lacks as typed nulls; never drop, rename or retype one."""
    have = set(df.columns)
    missing = [f for f in schema.fields if f.name not in have]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
