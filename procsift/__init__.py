"""Process-telemetry anomaly engine on Spark."""
