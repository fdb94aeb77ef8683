"""Spark jobs over UTxO-ledger tables, and training-data operations in `llm`."""
