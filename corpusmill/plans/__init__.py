"""Plan-level helpers: materialisation, pipelines."""
