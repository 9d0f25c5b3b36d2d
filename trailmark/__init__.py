"""Analytics over agent event logs and text corpora, expressed as Spark plans."""
