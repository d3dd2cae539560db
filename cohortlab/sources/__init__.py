"""Sources and sinks: typed CSV scans, Parquet stage I/O, and the mapping of the
driver's TPC-H-style tables onto the study's logical input tables."""
