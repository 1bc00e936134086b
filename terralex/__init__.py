"""terralex: ranked text search, language statistics and place analytics as PySpark DataFrame operators."""
