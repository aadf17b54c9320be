"""Spark-native operators for genotype-to-environment analytics and data quality."""
