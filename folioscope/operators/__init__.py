"""Operators of folioscope."""
