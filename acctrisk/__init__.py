"""Account-risk analytics on Spark: feature mart, model scoring and model-comparison tables."""
