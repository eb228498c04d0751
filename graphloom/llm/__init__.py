"""Training-data operators: deduplication, packing, mixing, filters, classifiers and sketches."""
