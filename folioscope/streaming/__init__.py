"""Streaming of folioscope."""
