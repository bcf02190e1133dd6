"""Learning-record analytics as Spark DataFrame functions."""
