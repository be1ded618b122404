"""Column functions and the fixed vowel inventory."""
