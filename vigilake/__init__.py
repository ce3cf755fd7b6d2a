"""Security-log detection and data-preparation operators expressed as Spark DataFrame plans."""
