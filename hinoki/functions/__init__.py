"""Text functions: categories, normalization, numerals, sentences, formats."""
