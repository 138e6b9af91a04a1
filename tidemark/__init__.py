"""Set-based analytics over tables of open-high-low-close-volume bars on Spark."""
