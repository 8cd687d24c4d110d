"""bibspark: bibliographic record processing as Spark dataflow."""
