"""Operations for training-data pipelines: filtering, near-duplicates, counts, packing.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its queries when it
is present.
"""
