"""The SQL dialect: parser, compiler, catalog and engine."""
