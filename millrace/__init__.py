"""millrace: declarative, resumable, model-assisted searches over large text corpora on Spark."""

__version__ = "0.1.0"
