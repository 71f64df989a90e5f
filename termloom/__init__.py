"""termloom: terminology, coded-record and training-data analytics as Spark plans."""
