"""lexmill: lexical and span analytics as ordinary Spark queries."""
