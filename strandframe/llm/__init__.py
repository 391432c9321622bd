"""Training-data operators: token counts, licence scans, near-dedup, decontamination, mixing and more.

Nothing outside this subpackage imports it.
"""
