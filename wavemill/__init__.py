"""Speech-stream analytics on Spark: chunks of PCM in, ordered transcript events out."""
