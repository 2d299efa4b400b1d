"""Column functions: cell statistics, addresses, number formats, text."""
