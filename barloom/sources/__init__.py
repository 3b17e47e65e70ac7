"""Reading and writing bars, orders and model tables, and the fixtures made from the given tables."""
