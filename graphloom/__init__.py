"""graphloom: Markdown collections to ontology-validated knowledge graphs, as Spark DataFrames."""
