"""Reading and keeping data: versioned snapshots, CSV with inferred schemas, JSON, dumps."""
