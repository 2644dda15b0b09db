"""quadloom: SPARQL 1.1 over RDF quads held in Spark DataFrames, and operators that prepare statement tables."""
