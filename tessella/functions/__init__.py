"""Part of the engine; see README.md for the list of modules."""
