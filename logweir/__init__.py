"""A log engine on Spark: detection, parsing, canonical records, analytics. ``logweir.llm`` holds the training-data operators."""

from .operators.detect import detect_bytes, detect_lines
from .operators.staging import distribution, page, per_source, report, select_records, sort_records, stage, totals
from .plans.batch import Store, run_files, run_path, run_records, run_staged
from .plans.semantic import Bypass, MappingProvider, map_records
from .session import build_session
from .sources.catalogue import Catalogue
from .sources.readers import errors, from_bytes, from_text, ingest, ingest_lines, ingest_path, list_files, read_files, register_parser, supported_formats
from .sources.sinks import to_dicts, write_csv, write_ndjson

__all__ = [
    "Bypass", "Catalogue", "MappingProvider", "Store", "build_session", "detect_bytes", "detect_lines", "distribution", "errors", "from_bytes", "from_text", "ingest", "ingest_lines", "ingest_path", "list_files", "map_records", "page", "per_source",
    "read_files", "register_parser", "report", "run_files", "run_path", "run_records", "run_staged", "select_records", "sort_records", "stage", "supported_formats", "to_dicts", "totals", "write_csv", "write_ndjson",
]
