"""A Spark-native engine for facts over time: change-only intervals, as-of reads and diffs."""
