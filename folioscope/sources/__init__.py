"""Sources of folioscope."""
