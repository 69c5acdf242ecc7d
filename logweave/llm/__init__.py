"""Training-data operators: formatting, language, licences, tokens, quality and deduplication."""
