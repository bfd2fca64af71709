"""Column expressions: geometry, fitted models, moments, class names."""
