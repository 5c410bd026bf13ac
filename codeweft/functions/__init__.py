"""codeweft subpackage."""
