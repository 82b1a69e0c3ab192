"""docsift: document understanding and linkage expressed as Spark plans."""

from docsift.config import Config, default, load
from docsift.operators.analyze import analyze
from docsift.operators.batches import Segregated
from docsift.plans.report import classify_buffers, config_frame, report_json, write_report
from docsift.plans.report import run_directory as process_directory
from docsift.sources.ingest import ingest, read_buffers, read_directory, read_pdf

__all__ = ["Config", "Segregated", "analyze", "classify_buffers", "config_frame", "default", "ingest", "load", "process_directory", "read_buffers", "read_directory", "read_pdf", "report_json", "write_report"]
