"""DataFrame operators of the merge."""
