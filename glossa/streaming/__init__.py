"""glossa.streaming."""
