"""Column functions of folioscope."""
