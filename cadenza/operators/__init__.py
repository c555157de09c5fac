"""DataFrame -> DataFrame operators with explicit partition keys and no driver-side collects."""
