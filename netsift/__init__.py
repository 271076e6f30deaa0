"""netsift: network-flow triage as Spark DataFrame jobs."""
