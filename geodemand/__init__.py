"""Place-by-product demand analytics expressed as Spark DataFrame operators."""
