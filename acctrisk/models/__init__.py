"""Model factories, out-of-fold scoring, tuning and stacking."""
