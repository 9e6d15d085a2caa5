"""Batch analytics over people, follow edges and page visits, written as DataFrame plans."""
