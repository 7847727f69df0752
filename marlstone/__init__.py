"""marlstone: evidence retrieval and market analytics as lazy PySpark DataFrame operators."""
