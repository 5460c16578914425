"""latticework: a Spark-native engine for asset-graph evidence tables."""
