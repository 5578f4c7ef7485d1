"""Training-data operators: extraction, dedup, decontamination, formatting, scoring, sharding."""
