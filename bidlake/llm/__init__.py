"""Operators for preparing training corpora. Nothing else in bidlake imports this subpackage."""
