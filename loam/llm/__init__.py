"""Training-data operators: deduplication, decontamination, mixing, token output and classifiers.

Nothing outside this subpackage imports it.
"""
