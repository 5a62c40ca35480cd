"""Multi-stage plans: model training, topics, end-to-end flow, driver-table adapters."""
