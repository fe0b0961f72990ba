"""Hierarchical histograms of numeric columns on Spark: build, merge, query, store.

    from binfold import build, merge, percentile, read_histogram
"""

from binfold.functions.configs import CONFIGS, config
from binfold.operators.histogram import Histogram, build, merge
from binfold.operators.many_axes import Axis, boundaries, count_boxes, grid
from binfold.operators.one_axis import cdf, max_count, max_value, min_count, min_value, percentile, top_k
from binfold.sources.readers import from_arrays, read, read_npy
from binfold.sources.tables import export, merge_stored, read_histogram, write_histogram

__all__ = ["CONFIGS", "Axis", "Histogram", "boundaries", "build", "cdf", "config", "count_boxes", "export", "from_arrays", "grid", "max_count", "max_value", "merge", "merge_stored", "min_count", "min_value", "percentile", "read", "read_histogram", "read_npy", "top_k", "write_histogram"]
