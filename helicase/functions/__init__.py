"""Column functions over sequences and alignment rows."""
