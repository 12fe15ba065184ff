"""Relational operators over project metadata: graph, diff, impact, verdict, policy and dashboard reach."""
