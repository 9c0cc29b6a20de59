"""Vector and matrix functions over vertex-keyed columns."""
