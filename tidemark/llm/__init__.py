"""Training-data operators over text corpora; nothing else in the library imports this subpackage."""
