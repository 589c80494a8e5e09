"""Quality assurance and reuse of translated segments, as Spark DataFrame operators."""
