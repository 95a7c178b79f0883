"""Context analytics as Spark jobs: tables in, tables out."""
