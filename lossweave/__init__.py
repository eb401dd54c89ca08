"""Token-level preparation of fine-tuning data on Spark."""
