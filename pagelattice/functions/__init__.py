"""Column functions: geometry, text cleaning, rendering."""
