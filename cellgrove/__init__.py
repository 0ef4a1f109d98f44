"""cellgrove: spatial, single-cell and table analytics written as Spark jobs."""
