"""Place-review and urban-site analytics as Spark DataFrame operators."""
