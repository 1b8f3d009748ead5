"""CSV readers with header and encoding repair, and table writers."""
