"""Clinical event sequences as Spark plans: scans, extraction, labels, time tokens, encoding and evaluation."""
