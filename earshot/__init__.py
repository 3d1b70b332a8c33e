"""earshot: Spark-native analytics over earnings-call transcripts and training-data tables."""
