"""quire: recovery and curation of scanned-page text as Spark DataFrame operators."""
