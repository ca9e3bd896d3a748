"""Event-sourced sessions and event-time streams."""
