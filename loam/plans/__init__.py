"""From query text to Spark SQL, and to predicates for pruning."""
