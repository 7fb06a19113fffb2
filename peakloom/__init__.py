"""peakloom: a Spark-first analytics engine for nested peak-list tables."""
