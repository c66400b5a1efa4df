"""corpuslode: retrieval, document analytics and corpus preparation as Spark DataFrame jobs."""
