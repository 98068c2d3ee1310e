"""glossa.plans."""
