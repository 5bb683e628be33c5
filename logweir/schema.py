"""Fixed schemas and tables."""

from __future__ import annotations

# The formats, in the order in which ties are broken.
FORMATS = ("json", "xml", "yaml", "binary", "syslog", "logfmt", "csv", "tsv", "key_value", "delimiter", "plain_text")

LOG_RECORD = (
    "record_id string, source string, line_number int, format string, timestamp string, timestamp_raw string, level string, message string, "
    "fields map<string,string>, corrupted boolean, corruption_reason string, raw string"
)
#: What the parsers hand to assemble(): text tells whether v was a string in its source.
PARSED = "source string, format string, line_number int, raw string, corrupted boolean, corruption_reason string, entries array<struct<k:string,v:string,text:boolean>>, fallback string"

PARSED_LOGS = (
    "record_id string, timestamp string, tool_id string, log_source string, log_type string, raw_line string, recipe_name string, process_step string, wafer_id string, lot_id string, chamber_id string, "
    "temperature double, pressure double, rf_power double, flow_rate double, voltage double, current double, alarm_code string, alarm_severity string, event_description string, status string, "
    "extra_fields map<string,string>, mapping_confidence double, parse_flags array<string>, anomaly_score double, dedup_key string, ingested_at string"
)
PARSE_FAILURES = "raw_line string, log_source string, error string, failed_at string"
LLM_FAILURES = "signature string, raw_line string, log_source string, error string, attempts int, failed_at string"
TEMPLATES = "signature string, template string, position_map map<int,string>, source string, hit_count long, created_at string"
FIELD_MAPPINGS = "vendor_field string, canonical_field string, created_at string"
REGISTRY = "signature string, format_type string, regex_patterns map<string,string>, confidence double, hit_count long, created_at string, updated_at string"

CANONICAL = tuple(c.split()[0] for c in PARSED_LOGS.split(", ") if not c.startswith("ingested_at"))
MEASUREMENTS = ("temperature", "pressure", "rf_power", "flow_rate", "voltage", "current")
LOG_TYPES = ("alarm", "sensor", "process", "event", "unknown")
SEVERITIES = ("critical", "warning", "info")

# Vendor names and the canonical fields that they stand for.
VENDOR_NAMES = {
    "temp": "temperature",
    "temp_c": "temperature",
    "temperature_c": "temperature",
    "tmp": "temperature",
    "temp_celsius": "temperature",
    "t_celsius": "temperature",
    "celsius": "temperature",
    "deg_c": "temperature",
    "pres": "pressure",
    "pres_pa": "pressure",
    "pressure_pa": "pressure",
    "press": "pressure",
    "pres_torr": "pressure",
    "chamber_pressure": "pressure",
    "p": "pressure",
    "rf": "rf_power",
    "rfpower": "rf_power",
    "rf_pwr": "rf_power",
    "power": "rf_power",
    "rf_watts": "rf_power",
    "flow": "flow_rate",
    "gas_flow": "flow_rate",
    "mfc_flow": "flow_rate",
    "flowrate": "flow_rate",
    "flow_sccm": "flow_rate",
    "volt": "voltage",
    "volts": "voltage",
    "v": "voltage",
    "bias_voltage": "voltage",
    "dc_bias": "voltage",
    "amp": "current",
    "amps": "current",
    "ampere": "current",
    "i": "current",
    "alarm": "alarm_code",
    "fault": "alarm_code",
    "error_code": "alarm_code",
    "err": "alarm_code",
    "fault_code": "alarm_code",
    "severity": "alarm_severity",
    "level": "alarm_severity",
    "alarm_level": "alarm_severity",
    "ts": "timestamp",
    "datetime": "timestamp",
    "time": "timestamp",
    "date_time": "timestamp",
    "log_time": "timestamp",
    "event_time": "timestamp",
    "created_at": "timestamp",
    "tool": "tool_id",
    "toolid": "tool_id",
    "machine": "tool_id",
    "machine_id": "tool_id",
    "equipment": "tool_id",
    "equip_id": "tool_id",
    "tool_name": "tool_id",
    "wafer": "wafer_id",
    "wfr": "wafer_id",
    "wafer_num": "wafer_id",
    "wfr_id": "wafer_id",
    "lot": "lot_id",
    "lot_number": "lot_id",
    "batch": "lot_id",
    "batch_id": "lot_id",
    "chamber": "chamber_id",
    "chm": "chamber_id",
    "chamber_num": "chamber_id",
    "ch": "chamber_id",
    "step": "process_step",
    "proc_step": "process_step",
    "step_name": "process_step",
    "process_step": "process_step",
    "recipe": "recipe_name",
    "rcp": "recipe_name",
    "process_recipe": "recipe_name",
    "rcp_name": "recipe_name",
    "type": "log_type",
    "log_type": "log_type",
    "category": "log_type",
    "state": "status",
    "tool_state": "status",
    "op_status": "status",
    "msg": "event_description",
    "message": "event_description",
    "description": "event_description",
    "desc": "event_description",
    "event": "event_description",
    "detail": "event_description",
}
