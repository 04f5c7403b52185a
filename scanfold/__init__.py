"""Content matching and risk analytics over DataFrames: signatures are tables, objects are tables, a scan is joins and roll-ups."""
