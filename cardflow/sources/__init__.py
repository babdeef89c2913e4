"""Typed readers, sinks and the shared-folder table store."""
