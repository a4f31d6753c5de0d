"""Readers and writers: sales tables, raw order tables, text tables, exports."""
