"""Fixed values of the data model: quality flags, limits and column orders."""

from __future__ import annotations

# fixed values: quality flags by bit, in order from bit 0
FLAG_NAMES = [
    "empty_line", "malformed_line", "unknown_comm_type", "unknown_message_type", "invalid_device_id", "invalid_receive_time", "invalid_position_time", "invalid_coordinate",
    "coordinate_unavailable", "cog_unavailable_or_invalid", "sog_unavailable_or_invalid", "heading_unavailable_or_invalid", "invalid_navigation_status", "invalid_rot",
    "invalid_position_accuracy", "invalid_static_field", "position_after_receipt", "file_date_mismatch", "text_gb18030", "text_invalid_encoding",
]
FLAG = {name: 1 << i for i, name in enumerate(FLAG_NAMES)}
HARD_INVALID = 255  # bits 0 to 7

# fixed values: limits
TIME_RANGE = (946_684_800, 4_102_444_800)
LON_LIMIT, LAT_LIMIT, DEGREE = 108_600_000, 54_600_000, 600_000.0
DATE_SLACK = 172_800
RECEIPT_SLACK = 300
EARTH_KM = 6371.0088
MESSAGES = ["5", "19", "21", "24A", "24B"]

RAW_COLUMNS = [f"c{i:02d}" for i in range(40)]
POSITION_COLUMNS = [
    "record_date", "source_file", "source_member", "line_number", "comm_type", "device_id", "mmsi", "receive_time_s", "source_id", "ais_message_id", "pos_time_s", "lon_raw", "lat_raw",
    "longitude_deg", "latitude_deg", "cog_raw", "cog_deg", "sog_raw", "sog_kn", "true_heading", "navigation_status", "rot", "position_accuracy", "field_count", "extension_field_count",
    "dq_mask", "is_hard_valid",
]
STATIC_COLUMNS = [
    "record_date", "source_file", "source_member", "line_number", "comm_type", "mmsi", "receive_time_s", "source_id", "ais_message_id", "imo", "callsign", "ship_name", "ship_type",
    "length_bow", "length_stern", "breadth_port", "breadth_starboard", "position_device_type", "eta_raw", "draught_raw", "draught_m", "destination", "dte", "aton_type", "aton_name",
    "aton_status", "vendor_id", "field_count", "extension_field_count", "dq_mask", "is_hard_valid",
]
SHARD_COLUMNS = ["mmsi", "receive_time_s", "ship_type", "imo", "callsign", "ship_name", "draught_m", "destination", "source_file", "line_number", "dq_mask"]
EVENT_COLUMNS = {"event_id": "string", "event_status": "string", "event_start_s": "bigint", "event_end_s": "bigint", "event_longitude_deg": "double", "event_latitude_deg": "double"}
DENSITY_COLUMNS = {"event_id": "string", "seawater_density_kg_m3": "double", "density_method": "string"}
