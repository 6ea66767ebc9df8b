"""Training-data operators over text and vectors. Nothing else in the library imports this subpackage."""
