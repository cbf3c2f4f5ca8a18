"""Training-data operators: filters, deduplication, language models and tokenisation."""
