"""Training-data operators: licences, search, deduplication, language, privacy, filtering and mixing."""
