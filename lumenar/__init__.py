"""A Spark-native engine for question-answering corpora, routing, confidence calibration and its evaluation."""
