"""Reading and checking observation matrices."""
