"""Training-data operators: deduplication, decontamination, classification, token counts, archives.

Nothing else in the library imports this subpackage.
"""
