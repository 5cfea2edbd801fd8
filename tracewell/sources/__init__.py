"""Reading trace documents and labels, storing tables, adapting activity tables."""
