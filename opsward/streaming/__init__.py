"""Structured Streaming: incremental drop-folder ingestion into the keyed warehouse."""
