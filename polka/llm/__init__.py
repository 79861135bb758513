"""Operators on texts: matching, repair, tokenising, mixing and quality of texts."""
