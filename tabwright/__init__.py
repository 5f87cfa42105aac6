"""A PySpark-native engine for verifying statements against small text tables, and large ones."""
