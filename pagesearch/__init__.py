"""Website search as Spark jobs: pages in, documents, postings and ranked results out."""
