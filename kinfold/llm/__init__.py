"""Training-data operators: near-duplicates, decontamination, scoring, mixing, packing."""
