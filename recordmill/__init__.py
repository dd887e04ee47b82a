"""recordmill: batch jobs that audit large tables of text records, written as Spark DataFrame plans."""
