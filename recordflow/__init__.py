"""Turn tables, documents and model responses into schema-conformant records on Spark."""
