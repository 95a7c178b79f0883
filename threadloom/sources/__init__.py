"""Tables of units and edges from conversations and pages."""
