"""vertexloom: graph analytics as Spark DataFrame plans."""
