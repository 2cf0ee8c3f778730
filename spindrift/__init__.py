"""spindrift: code analytics over a corpus of source files, as Spark DataFrame operators."""
