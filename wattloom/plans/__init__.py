"""Named queries over a data directory."""
