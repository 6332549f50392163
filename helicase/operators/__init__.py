"""DataFrame operators of the screen: blocks, intervals, hits, models."""
