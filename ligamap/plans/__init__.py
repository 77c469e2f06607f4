"""Named queries, their SQL, and the service functions."""
