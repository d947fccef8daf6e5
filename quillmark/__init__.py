"""Document-originality analytics as lazy Spark plans."""
