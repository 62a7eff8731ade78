"""Citations in German legal text, found, resolved and scored on Spark."""
