"""Query plans of folioscope."""
