"""Stream and batch analytics as lazy Spark plans."""
