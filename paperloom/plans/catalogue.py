"""The modules that hold queries; each has QUERIES (name -> function) and ORACLE (name -> SQL)."""

from paperloom.plans import graph_queries, problem_queries, record_queries

MODULES = [problem_queries, graph_queries, record_queries]
