"""Training-data operators: token counts, archives, near-duplicates, packing, classifiers.

Nothing outside this subpackage imports it.
"""
