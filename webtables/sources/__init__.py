"""Readers, sinks and keyed table maintenance."""
