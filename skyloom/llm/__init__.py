"""Training-data operators: ten Spark jobs over documents and pages, each in a module of its own."""
