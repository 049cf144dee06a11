"""Jobs on whole batches: scan, redaction, organizing, labels, index, report."""
