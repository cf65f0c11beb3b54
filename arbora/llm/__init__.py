"""Training-data operators on texts.  Nothing else in the library imports this subpackage."""
