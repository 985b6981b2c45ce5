"""Every operator as a query over the given tables, beside plain SQL that gives the same rows."""

from fleetlens.catalogue import applications, clusters, statements, workflows

MODULES = [applications, clusters, workflows, statements]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in MODULES for name, text in module.ORACLES.items()}
