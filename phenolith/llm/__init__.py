"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

import importlib

from pyspark import cloudpickle

#: Their functions travel to the executors by value: a cluster needs no copy of this package.
for _name in ("bytescan", "storage", "token_counts", "license_scan", "packing", "near_dup", "lm_score", "quality", "suffix_dedup", "topk", "html_extract", "merkle", "vector_codes"):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
