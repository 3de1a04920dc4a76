"""Registered queries, their SQL counterparts, and plans composed of operators."""
