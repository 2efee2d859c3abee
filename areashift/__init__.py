"""Compare a measured rate between two periods across units whose boundaries change."""
