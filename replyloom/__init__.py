"""Reply-thread analytics as PySpark DataFrame operators."""
