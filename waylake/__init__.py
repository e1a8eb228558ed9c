"""waylake: a PySpark-native engine for place snapshots and semi-structured guide documents."""
