"""votaria: a PySpark-native analytics engine for roll-call votes and the documents around them."""
