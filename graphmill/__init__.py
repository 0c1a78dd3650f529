"""graphmill: a PySpark-native engine for code knowledge graphs, retail segmentation and data privacy."""

__version__ = "0.1.0"
