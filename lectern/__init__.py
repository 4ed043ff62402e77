"""lectern: Spark jobs for collections of assessment items, text and vectors."""
