"""Training-data operators (token counts, decontamination, deduplication, ...).

Nothing else in the library imports this subpackage; it can be deleted and the
rest keeps working.
"""
