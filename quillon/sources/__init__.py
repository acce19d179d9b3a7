"""Table readers, table writers and configuration."""
