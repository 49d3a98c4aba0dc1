"""A PySpark-native analytics engine for research-funding and bibliographic data."""
