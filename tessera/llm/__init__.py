"""Training-data operators: toxicity, mixing, dedup, extraction, decontamination, sharding, language ID."""
