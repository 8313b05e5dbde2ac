"""textloom: corpus curation, detector features and evaluation statistics as Spark DataFrame operators."""
