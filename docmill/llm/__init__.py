"""Ten operators for preparing training data, each with a thin query in :mod:`docmill.llm.queries`."""
