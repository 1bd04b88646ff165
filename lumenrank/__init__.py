"""lumenrank: retrieval-set preparation and search evaluation as Spark jobs.

Everything is expressed with the DataFrame API so Catalyst can prune columns,
push filters into the Parquet scan and pick join strategies; Python runs only
inside Arrow-batched ``mapInPandas`` kernels (block matmul, pluggable encoders).
"""

from lumenrank.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
