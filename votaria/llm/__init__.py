"""Operators on text for training data: canonical form, scan repair, leakage, mixing and personal data."""
