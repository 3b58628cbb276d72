"""PySpark-native influence-maximisation engine on factor-mediated networks."""
