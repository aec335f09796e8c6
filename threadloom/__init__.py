"""Analytics over sessions, messages and events as Spark DataFrames."""
