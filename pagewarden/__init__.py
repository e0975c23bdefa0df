"""A PySpark-native engine for web-site quality auditing."""
