"""Analytics over large collections of recordings, and operators for text corpora, on Spark."""
