"""Value-level rules: literals, dates, predicates, text normalisation."""
