"""Training-data operators: classifiers, PII, licences, secrets, dedup, packing, search and counts."""
