"""corpusloom: corpus analytics, evaluation and training-data operators as Spark plans."""
