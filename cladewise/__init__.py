"""A Spark-native engine for minimizer-index sequence classification, its taxonomy reports and corpus operators."""
