"""Sources: driver tables, feed registry scans, files, rule files, logs, text."""
