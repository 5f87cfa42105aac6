"""Column functions: cell normalisation, numbers, verdicts and label parsing."""
