"""RDF terms, XSD lexical forms and the SPARQL function library."""
