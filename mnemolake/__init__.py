"""Analytics over long-term agent memory, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
