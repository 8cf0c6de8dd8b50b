"""Named queries over the table of vectors, and the same in SQL."""
