"""Named queries over the test tables."""
