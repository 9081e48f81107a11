"""Feature spaces, detectors and model experiments on spark.ml."""
