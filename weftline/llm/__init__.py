"""Training-data operators: filters, classifiers, dedup, tokenisation, archives and counts for LLM corpora."""
