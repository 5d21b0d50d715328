"""Evidence-keeping analytics on Spark: validation, entity resolution, link graph, questions."""
