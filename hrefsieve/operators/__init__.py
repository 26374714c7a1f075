"""DataFrame to DataFrame stages of an audit."""
