"""Spark-native evaluation of robot rollouts, and corpus operators in `gradewright.llm`."""
VERSION = "0.1.0"
