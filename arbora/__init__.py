"""Spark-native treebank analytics: corpora in, statistics, selections, prompts and scores out."""

__version__ = "0.1.0"
