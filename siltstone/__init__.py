"""siltstone: content preparation and retrieval expressed as Spark plans.

Sub-packages: ``functions`` (column expressions), ``sources`` (scans and container
formats), ``operators`` (DataFrame -> DataFrame), ``sinks``, ``streaming``, ``plans`` (registered
queries with their SQL twins).  ``llm`` holds the training-data operators; nothing
outside it imports it.
"""
