"""tessera: searching, cleaning and resolving catalogues of text records on Spark."""
