"""Training-data operators. Optional: nothing outside this subpackage imports it."""
