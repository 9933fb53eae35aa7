"""A catalog-intelligence and report-analytics engine on PySpark."""
