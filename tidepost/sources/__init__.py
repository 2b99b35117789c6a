"""Landed responses, payload adapters, sheets, table state and sinks."""
