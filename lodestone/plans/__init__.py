"""From dialect text to Spark plans."""
