"""Column functions for money, dates and text."""
