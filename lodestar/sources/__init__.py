"""Sources and sinks: tagged records, JSON-lines collections, archives, the dataset registry, bulk payloads."""
