"""Analytics over timed media tables as Spark plans."""
