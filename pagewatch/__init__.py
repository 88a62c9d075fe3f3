"""pagewatch: notice monitoring over page corpora, written as Spark jobs."""
