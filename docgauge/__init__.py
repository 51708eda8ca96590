"""docgauge: Spark DataFrame library for document-parse evaluation at corpus scale."""
