"""folioscope: analytics over scanned case files, expressed as Spark plans."""
