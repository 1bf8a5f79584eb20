"""wordloom: composable ``DataFrame -> DataFrame`` operators for text corpora on Spark."""
