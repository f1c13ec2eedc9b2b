"""Maintenance-reliability analytics over machine-stop logs, expressed as Spark DataFrame operators."""
