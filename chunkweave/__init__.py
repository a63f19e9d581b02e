"""chunkweave: virtual chunked arrays as Spark relations.

A virtual array is a small metadata record plus a DataFrame of chunk references
(grid index -> path, byte offset, byte length, or inlined bytes).
"""

__version__ = "0.1.0"
