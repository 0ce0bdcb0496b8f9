"""tidemark: a PySpark-native engine for clock-aligned streams, interval labels and trigger evaluation."""
