"""Point-in-time analytics on Spark: as-of joins, probability scoring, divergence detection, gated verdicts."""
