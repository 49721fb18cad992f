"""Table catalog, typed readers and writers, input schemas."""
