"""Column functions: masks, keys, templates, payloads, row filters."""
