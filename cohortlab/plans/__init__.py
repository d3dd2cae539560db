"""Stage plans (preprocess -> features -> reports -> models -> evaluation) and the
query registry used by ``__spark_entry__``."""
