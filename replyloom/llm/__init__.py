"""Training-data operators: cleaning, de-duplication, scoring, formatting and mixing of text corpora."""
