"""Training-data operators: tokenising, language, duplicates, packing, secrets, licences, search, scoring."""
