"""dialoom: question/answer dataset building from document text on PySpark."""
