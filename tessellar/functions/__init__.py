"""Scalar expressions: identity, text and classification. All are Column expressions; nothing here starts a job."""
