"""Spark-native point-cloud and segmentation analytics."""
