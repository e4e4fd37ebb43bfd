"""kinolake: a Spark-first engine for exploring and labelling video collections."""
