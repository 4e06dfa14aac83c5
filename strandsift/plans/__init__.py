"""The SequenceDB object, pipelines, and the queries the driver runs."""
