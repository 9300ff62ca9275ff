"""Rules, findings, decisions and the order in which they act."""
