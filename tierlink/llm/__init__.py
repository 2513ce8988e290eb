"""Training-data operators: language id, near-dedup, LM scoring, packing, decontamination,
toxicity, license scan, quality rules, substring dedup and HTML extraction."""
