"""quill: structured-document analytics and evidence retrieval on Spark."""
