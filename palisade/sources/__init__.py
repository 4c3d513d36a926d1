"""Where texts, payloads and logs come from and where results go."""

from palisade.sources.readers import coverage_log, files, payloads
from palisade.sources.writers import append_coverage, scan_and_write_clean, scan_and_write_redacted, write_clean, write_redacted

__all__ = ["append_coverage", "coverage_log", "files", "payloads", "scan_and_write_clean", "scan_and_write_redacted", "write_clean", "write_redacted"]
