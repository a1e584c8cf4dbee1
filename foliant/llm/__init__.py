"""Training-data operators: deduplication, quality, decontamination, packing, archives and language-model scoring.

Nothing else in the library imports this subpackage.
"""
