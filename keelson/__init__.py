"""Table synchronisation and reconciliation, expressed as Spark plans."""
