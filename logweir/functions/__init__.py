"""Column functions over log text. Each takes and returns Columns and runs in the JVM."""

from .level import extract_level, level_name
from .numeric import coerce_value, parse_numeric, remove_units, try_numeric
from .show import label_text, number_text, percent_text
from .signature import generate_signature, mask_variables, schema_fingerprint, tokenise
from .text import clean_text, decode_bytes, normalize_whitespace, split_lines, strip_control_characters
from .time import extract_timestamp, parse_timestamp, standardise_timestamp, to_iso8601
from .transforms import TRANSFORMS, apply_transform
from .units import normalise_units

__all__ = [
    "TRANSFORMS", "apply_transform", "clean_text", "coerce_value", "decode_bytes", "extract_level", "extract_timestamp", "generate_signature", "label_text", "level_name", "mask_variables",
    "normalise_units", "normalize_whitespace", "number_text", "parse_numeric", "parse_timestamp", "percent_text", "remove_units", "schema_fingerprint", "split_lines", "standardise_timestamp", "strip_control_characters",
    "to_iso8601", "tokenise", "try_numeric",
]
