"""DataFrame operators over the canonical contract table."""
