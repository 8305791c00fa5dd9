"""Writers of text formats."""
