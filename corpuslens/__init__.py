"""Analytics over large collections of source code, written as Spark DataFrame jobs."""
