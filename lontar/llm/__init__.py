"""Training-data operators: fingerprints, filters, dedup, decontamination, mixing, scoring, archives.

Nothing outside this subpackage imports it.
"""
